"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import discard, new_path, shared_dir, staged

__all__ = ["key_bitmap", "in_bitmap", "without_rows", "fresh", "text_key", "discard", "new_path", "shared_dir", "staged", "table", "bytes_of", "per_batch", "runs", "mix64", "mod_crc32", "partitions_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mod_crc32(column: str, n: int):
    """crc32 of the column as text, modulo n (NULL counts as the text '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over Arrow batches; batches that yield nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 200_000) -> Iterator[pa.Table]:
    """Join and cut a sorted stream so that rows of equal ``keys`` are never split."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < at_least:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        starts = run_starts([whole[k].to_numpy() for k in keys])
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
        rows = whole.num_rows - cut
    if held:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Positions at which a sorted composite key changes, the first included."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator: a bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix64(keys.view(np.uint64)) >> np.uint64(64 - bits)


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit for each hashed key (one bigint column, no NULLs); at most 2**(bits - 6) rows reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros(1 << (bits - 6), np.uint64)
        for part in batches:
            bit = np.unique(_bits(part.column(0).to_numpy(), bits))
            np.bitwise_or.at(masks, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(masks[at].view(np.int64))], ["word", "mask"])

    out = np.zeros(1 << (bits - 6), np.int64)
    for r in keys.mapInArrow(mark, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        out[r.word] = r.mask
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set: true for all keys of the bitmap, and a few others."""
    bit = _bits(keys, int(len(bitmap) * 64).bit_length() - 1)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        taken.add(name)
        out.append(name)
    return out


def text_key(column: str):
    """A hash of a text, which tells the texts of rows with one id apart (NULL counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _row_key(id_column, key_column):
    """One number for an id and a text key."""
    return F.xxhash64(F.coalesce(id_column.cast("bigint"), F.lit(0)), id_column.isNull(), key_column)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 24) -> DataFrame:
    """``docs`` without the rows that are in ``gone``: (id, text key) in its first two columns.

    A bitmap of fixed size tells most rows apart where they are read.  Only rows
    whose bit is set are joined, so texts that stay are not shuffled; however
    full the bitmap, the join decides.  Columns of any name are passed on.
    """
    gone_id, gone_key, hashed = fresh(docs, "gone_id", "gone_key", "hashed")
    gone = gone.select(F.col(gone.columns[0]).cast("bigint").alias(gone_id), F.col(gone.columns[1]).alias(gone_key))
    bitmap = key_bitmap(gone.select(_row_key(F.col(gone_id), F.col(gone_key)).alias("key")), bits)

    @F.arrow_udf("boolean")
    def perhaps(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bitmap, keys.to_numpy(zero_copy_only=False)))

    keyed = docs.withColumn(hashed, text_key(text_col))
    maybe = perhaps(_row_key(F.col(id_col), F.col(hashed)))
    sure = keyed.filter(~maybe).select(*docs.columns)
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(gone_id)) & (F.col(hashed) == F.col(gone_key))
    rest = keyed.filter(maybe).join(gone, same, "left_anti").select(*docs.columns)
    return sure.unionByName(rest)
