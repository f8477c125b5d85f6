"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive K-grams the one with the smallest hash is kept,
on either side.  A span of K + WINDOW - 1 = 10 shared words contains the same
window of K-grams on both sides, so it shares a kept fingerprint: no such span
is missed.  Fingerprints are joined, and each hit is extended over the words
around it, compared as text, up to the 10 words that a window can reach.

Items of fewer than 10 words are windows of their own length; for the at most
nine such lengths, documents are fingerprinted at every position.

A fixed-size bitmap of the items' fingerprints (``BITMAP_BITS``, whatever the
size of the benchmark) is sent to the tasks and keeps fingerprints that no item
has out of the shuffle; what passes is joined by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, per_batch, staged, table, text_key, without_rows
from .words import Words, chunks, winnow

SPAN = 10
K = 5
BITMAP_BITS = 24
HIT = "fp bigint, pos int, size int, before array<string>, after array<string>"


def _marks(words: Words, short: list[int], span: int, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, fingerprints): size 0 for winnowed K-grams, else the length of short items."""
    hashes = words.hashes()
    grams, valid = words.grams(hashes, k)
    kept = winnow(grams, valid, span - k + 1)
    out = [(0, kept, grams[kept])]
    for n in short:
        grams, valid = words.grams(hashes, n)
        at = np.flatnonzero(valid)
        out.append((n, at, grams[at] ^ np.uint64(n << 32)))
    return out


def _hit(words: Words, at: int, fp: int, size: int, span: int, k: int) -> dict:
    text = words.text[at]
    low, high = words.first[text], words.first[text + 1]
    before = [] if size else [words.word(i) for i in range(at - 1, max(low, at - span + k) - 1, -1)]
    after = [words.word(i) for i in range(at, min(high, at + (size or span)))]
    return {"fp": fp, "pos": int(at - low), "size": size, "before": before, "after": after}


HIT_TYPE = pa.list_(pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def item_marks(items: DataFrame, id_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """(item_id, hit...) rows: fingerprints of the test items with the words around them."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, hits = bytes_of(rows.column(1)), []
        for part in chunks(texts):
            words = Words(texts[part])
            found: list[list[dict]] = [[] for _ in range(len(words.counts))]
            for i, n in enumerate(words.counts):
                if 0 < n < span:
                    alone = Words([texts[part][i]])
                    grams, _ = alone.grams(alone.hashes(), int(n))
                    found[i].append(_hit(alone, 0, int((grams ^ np.uint64(int(n) << 32)).view(np.int64)[0]), int(n), span, k))
            for size, at, fps in _marks(words, [], span, k):
                for a, f in zip(at, fps.view(np.int64), strict=True):
                    found[words.text[a]].append(_hit(words, int(a), int(f), size, span, k))
            hits += found
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(hits, HIT_TYPE)], ["item_id", "hits"])

    slim = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    marked = per_batch(slim, batch, f"item_id string, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    return marked.select("item_id", F.inline("hits"))


def _bitmap(marks: DataFrame, bits: int) -> np.ndarray:
    """Bit (top ``bits`` bits of the fingerprint) set for every item's fingerprint; at most 2**(bits - 6) rows reach the driver."""
    bit = F.shiftrightunsigned("fp", 64 - bits)
    words = marks.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int))")).alias("mask"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.collect():
        out[r.word] = r.mask
    return out.view(np.uint64)


def document_marks(docs: DataFrame, bitmap: np.ndarray, short: list[int], text_col: str, span: int, k: int, bits: int) -> DataFrame:
    """``docs`` rows as (row_id, doc_id, key, n_words, hits): only hits whose bit is set."""
    shift = np.uint64(64 - bits)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, hits = bytes_of(rows.column(1)), [], []
        for part in chunks(texts):
            words = Words(texts[part])
            found: list[list[dict]] = [[] for _ in range(len(words.counts))]
            for size, at, fps in _marks(words, short, span, k):
                bit = fps >> shift
                passed = np.flatnonzero((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                for a, f in zip(at[passed], fps[passed].view(np.int64), strict=True):
                    found[words.text[a]].append(_hit(words, int(a), int(f), size, span, k))
            counts += words.counts.tolist()
            hits += found
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(counts, pa.int64()), pa.array(hits, HIT_TYPE)], ["doc_id", "key", "n_words", "hits"])

    slim = docs.select("doc_id", F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    marked = per_batch(slim, batch, f"doc_id bigint, key bigint, n_words bigint, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    return marked.select(F.monotonically_increasing_id().alias("row_id"), "*")


def _common(a: str, b: str) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, bits: int = BITMAP_BITS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, key), one row per row of ``docs``; key is the hash of its text.

    Words are runs of digits, letters and non-ASCII characters after lower-casing
    A-Z.  A NULL or wordless text has none and is never hit; a wordless item hits
    nothing.  Rows that repeat an id are judged one by one.  Very long texts count
    whole; an empty table gives no rows; other columns are not read.  Items with a NULL id
    hit words but are not listed; items that repeat an id count once.
    """
    tests = staged(item_marks(items, item_id_col, item_text_col, span, k).distinct(), "items")
    short = sorted(r[0] for r in tests.filter("size > 0").select("size").distinct().collect())
    bitmap = _bitmap(tests, bits)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marked = staged(document_marks(slim, bitmap, short, "text", span, k, bits), "marks")
    ours = marked.select("row_id", F.inline("hits"))
    theirs = tests.select("item_id", "fp", F.col("size").alias("t_size"), F.col("before").alias("t_before"), F.col("after").alias("t_after"))
    met = (
        ours.join(theirs, "fp").filter("size = t_size")
        .withColumn("left", _common("before", "t_before")).withColumn("right", _common("after", "t_after"))
        .filter(f"if(size > 0, right = size, right >= {k} and left + right >= {span})")
        .select("row_id", (F.col("pos") - F.when(F.col("size") > 0, 0).otherwise(F.col("left"))).alias("low"), (F.col("pos") + F.col("right")).alias("high"), "item_id")
    )
    met = staged(met, "met")
    spans = met.select("row_id", "low", "high").distinct()
    reached = F.expr("max(high) over (partition by row_id order by low, high rows between unbounded preceding and 1 preceding)")
    hit = (
        spans.withColumn("reached", F.coalesce(reached, F.lit(0)))
        .groupBy("row_id").agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", "reached"))).alias("n_hit"))
    )
    named = met.groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    both = staged(hit.join(named, "row_id"), "hits")
    discard(tests)
    return marked.select("row_id", "doc_id", "key", "n_words").join(both, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "key",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a hit, all columns kept, whatever their names.

    Rows are told apart by id and hash of the text: a row that shares its id with
    a hit one, or has none like it, stays.  An empty table gives no rows.
    """
    bad = staged(contamination(docs, items).filter("n_hit > 0").select("doc_id", "key").distinct(), "bad")
    return without_rows(docs, bad)


def op8_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, coalesce({_WORDS.format('text')}, []) as w from documents),
 b as (select item_id, {_WORDS.format('text')} as w from benchmark where text is not null),
 bw as (select distinct item_id, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as g
        from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
 sizes as (select distinct n from bw),
 dw as (select doc_id, i, n, list_slice(w, i, i + n - 1) as g
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
 hits as (select doc_id, i, bw.n as n, item_id from dw join bw on dw.g = bw.g),
 hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
 hit_items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)"""
