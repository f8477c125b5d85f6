"""A training corpus from raw documents, in five stages.

1. The quality classifier takes out documents that score below its threshold.
2. Of each group of SimHash near-duplicates one document stays.
3. Documents that share a 10-word window with a benchmark item go.
4. Personal data is replaced by the name of its kind.
5. Texts are encoded into sampled pieces, which decode to the text again.

Each stage works on all rows that its predecessor kept and is written before the
next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import staged, table
from linkloom.llm.pieces import sampled_pieces
from linkloom.llm.pii import redact
from linkloom.llm.quality import keep_good
from linkloom.llm.simhash import keep_one
from linkloom.llm.winnowing import drop_contaminated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("piece_encoding", piece_encoding),
]

#: The classifier, the labelers' reliabilities and the sampled pieces are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, lossless, n_pieces, ids_crc32) of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
