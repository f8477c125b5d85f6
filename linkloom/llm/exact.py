"""Exact duplicates through an extendible-hash index on shared files, with DataFrame operations only.

The key of a text is a 64-bit hash of its characters other than white space.  A
directory of 2**depth slots points at buckets, each of which owns the range of
keys that begin with its prefix.  An overfull bucket is split by one more bit,
and the directory doubles until every bucket fits (``directory``).  A key that
would fill much of a bucket by itself does not count, since no split can part it:
its rows go to overflow pages of their own, so a text that makes up a third of all
rows is dealt over many tasks.

Rows go to the task that owns their bucket and page.  There, texts of one key are
told apart by comparing them byte for byte: every text of its own is an entry,
and entries that share a key form a chain.  Pages of one bucket are merged in the
same way.  The entries are written to the shared folder; a row finds its entry
again by the key and the SHA-256 digest of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions_of, staged, table

#: Rows of a bucket at least, and buckets at most: with more rows than their product, buckets grow.
CAPACITY = 256
BUCKETS = 1 << 15
#: The directory has at most 2**MAX_DEPTH slots, whatever the keys; buckets overfull at that depth get pages.
MAX_DEPTH = 20
#: Bits by which one job can double the directory.
STEP = 10
WHITE = "\x20\t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _key(text: Column, key_bits: int) -> Column:
    key = F.xxhash64(text)
    return key if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)


def _prefix(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def _heavy(capacity: int) -> Column:
    return 4 * F.col("n") > capacity


def heavy_keys(keys: DataFrame, capacity: int) -> DataFrame:
    """(key, key_pages) of the keys that have more than a quarter of a bucket's rows: at most 4 * BUCKETS of them."""
    return staged(keys.filter(_heavy(capacity)).select("key", F.ceil(F.col("n") / capacity).alias("key_pages")), "heavy")


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(slot, bucket, pages) of every slot that has rows, and the depth; ``keys`` has (key, n).

    ``slot`` is the first ``depth`` bits of a key.  ``bucket`` names the prefix that
    owns the slot; ``pages`` is above 1 where it is overfull at ``max_depth``.
    Rows of heavy keys do not fill a bucket.  No keys give an empty directory.  It
    has 2**max_depth rows at most.
    """
    leaves, open_, depth = [], keys.withColumn("n", F.when(_heavy(capacity), 0).otherwise(F.col("n"))), 0
    while True:
        deep = min(depth + STEP, max_depth)
        fine = open_.groupBy(_prefix("key", deep).alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
        sizes = (
            fine.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"), "*")
            .groupBy("depth", F.expr(f"shiftrightunsigned(prefix, {deep} - depth)").alias("prefix")).agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))
            .withColumn("overfull", (F.col("n") > capacity) & (F.col("keys") > 1))
        )
        sizes = staged(sizes, "buckets")
        above = sizes.filter("overfull").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        # a bucket stays as it is once it fits, or has one key, and the one it came from did not
        split = sizes.withColumn("above", F.shiftright("prefix", 1)).join(above, ["depth", "above"], "left_semi")
        reached = split if leaves else split.unionByName(sizes.filter("depth = 0").withColumn("above", F.lit(0).cast("bigint")))
        leaves.append(reached.filter("not overfull" if deep < max_depth else f"not overfull or depth = {max_depth}").select("depth", "prefix", "n"))
        still = sizes.filter(f"overfull and depth = {deep}")
        if deep == max_depth or not still.take(1):
            break
        open_ = open_.join(F.broadcast(still.select(F.col("prefix").alias("deeper"))), _prefix("key", deep) == F.col("deeper"), "left_semi")  # at most 2**MAX_DEPTH rows
        depth = deep
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.unionByName(more)
    buckets = staged(buckets, "buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))
    named = buckets.select(F.explode(slots).alias("slot"), F.expr("shiftleft(1L, depth) + prefix").alias("bucket"), pages.alias("pages"))
    return staged(named, "directory"), depth


def entries(docs: DataFrame, slots: DataFrame, depth: int, heavy: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(bucket, key, sha256, n, chars, keep_id) of every text: the index.

    The row that stays has the most code points before normalising, then the
    smallest id, NULL last.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("chars"), normalised(F.col(text_col)).alias("body"))
    rows = rows.withColumn("key", _key(F.col("body"), key_bits)).withColumn("page", F.monotonically_increasing_id())
    # both bounded, by MAX_DEPTH and by BUCKETS
    owned = rows.withColumn("slot", _prefix("key", depth)).join(F.broadcast(slots), "slot").join(F.broadcast(heavy), "key", "left")
    owned = owned.withColumn("pages", F.greatest("pages", "key_pages"))
    dealt = owned.withColumn("page", F.pmod(F.xxhash64("page"), F.col("pages"))).repartition(partitions_of(docs), "bucket", "page")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id"))
    found = dealt.groupBy("key", "body", "bucket", "page", "pages").agg(best.alias("best"), F.count("*").alias("n"))
    digest = F.sha2(F.col("body").cast("binary"), 256).alias("sha256")
    pages = staged(found.select("bucket", "key", digest, F.when(F.col("pages") > 1, F.col("body")).alias("body"), "best", "n"), "pages")
    several = pages.filter("body is not null").groupBy("key", "body", "bucket").agg(F.first("sha256").alias("sha256"), F.min("best").alias("best"), F.sum("n").alias("n"))
    whole = pages.filter("body is null").drop("body").unionByName(several.drop("body"))
    out = staged(whole.select("bucket", "key", "sha256", "n", (-F.col("best.less")).alias("chars"), F.col("best.id").alias("keep_id")), "entries")
    discard(pages)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal if nothing but white space (blank, tab to carriage return)
    tells them apart; NULL counts as empty, and texts of white space alone are
    equal to it.  Of equal texts the longest original stays, then the smallest id;
    rows without an id come last, and of rows that repeat id and text one stays.
    Other columns of ``docs`` are not read, whatever their names.  An empty table
    gives no rows.  ``key_bits`` below 64 makes keys collide, for tests.
    """
    body = normalised(F.col(text_col))
    slim = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("bigint").alias("doc_id"), _key(body, key_bits).alias("key"),
        F.sha2(body.cast("binary"), 256).alias("text_sha256"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("chars"),
    )
    slim = staged(slim, "rows")
    keys = staged(slim.groupBy("key").agg(F.count("*").alias("n")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    capacity = max(capacity, -(-total // BUCKETS))
    slots, depth = directory(keys, capacity)
    index = entries(docs, slots, depth, heavy_keys(keys, capacity), id_col, text_col, key_bits)
    shared = index.filter("n > 1").select("key", F.col("sha256").alias("text_sha256"), "n", F.col("chars").alias("most"), "keep_id")
    met = slim.join(shared, ["key", "text_sha256"], "left")
    met = staged(met.withColumn("best", F.expr("n is not null and chars = most and doc_id <=> keep_id")), "met")
    # rows that repeat id and text: the first one stays
    first = met.filter("best").groupBy("key", "text_sha256").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("first"))
    out = met.join(first, "row_id", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("n").isNull() | F.coalesce("first", F.lit(False))).alias("kept"), "text_sha256",
    )
    discard(slim, keys)
    return out


def op12_extendible_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
 r as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by body) as n from d
   window w as (partition by body order by chars desc, doc_id nulls last rows between unbounded preceding and unbounded following))
select doc_id, keep_id, n as group_size, place = 1 as kept, text_sha256 from r"""
