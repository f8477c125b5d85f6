"""Hard negatives by exact inner products from subset-sum tables (the method of the Four Russians).

Components are integers.  For each anchor and each group of eight dimensions a
table holds the sums of all 256 subsets of the anchor's components.  Candidates
are kept as bit planes: for each bit of a component and each group, one byte says
which of the eight dimensions have the bit.  A score is then a sum of table
lookups by these bytes, shifted and added plane by plane; the plane of the sign
counts negatively.  Scores are full and exact.

Anchors are a stated query set that meets all rows in blocks: candidates are
packed into chunks, and the written blocks and chunks meet as a cartesian
product, whose tasks read some blocks and some chunks each.  Blocks are neither
copied for each part nor broadcast, so nothing that grows with the rows passes
through the driver.  A task holds its chunks and the tables of one block at a
time.  Only the best rows of a chunk leave it, and of these only the best of a
task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import by_merge
from .common import discard, partitions_of, staged, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores from LOW/100 to HIGH/100 of the positive.
LOW, HIGH = 80, 100
GROUP = 8
CHUNK = 1024
BLOCK = 512
CHUNKS = "ids binary, rows binary, labels binary, planes binary"
BLOCKS = "block bigint, ids binary, rows binary, labels binary, vectors binary, bounds binary"
FOUND = "anchor_row bigint, anchor_id bigint, bound int, id bigint, row bigint, score bigint"
NOTHING = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, row, label, vector) of the rows that take part, components as integers; written."""
    finite = f"not exists({vector_col}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.expr(finite))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return staged(rows.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("bigint").alias("label"), whole.alias("vector")), "vectors")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(matrix: np.ndarray, bits: int) -> np.ndarray:
    """uint8 [bits, groups, rows]: the bit of each of eight dimensions, lowest dimension first."""
    rows, width = matrix.shape
    padded = np.zeros((rows, -(-width // GROUP) * GROUP), np.int64)
    padded[:, :width] = matrix
    planes = (padded[None] >> np.arange(bits)[:, None, None]) & 1
    return np.packbits(planes.astype(np.uint8).reshape(bits, rows, -1, GROUP), axis=-1, bitorder="little")[..., 0].transpose(0, 2, 1).copy()


def subset_sums(matrix: np.ndarray, dtype: type) -> np.ndarray:
    """[groups, 256, anchors]: sums of every subset of each anchor's eight components."""
    anchors, width = matrix.shape
    groups = -(-width // GROUP)
    padded = np.zeros((anchors, groups * GROUP), dtype)
    padded[:, :width] = matrix
    parts = padded.reshape(anchors, groups, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups, 1 << GROUP, anchors), dtype)
    for i in range(GROUP):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + parts[:, i : i + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[rows, anchors]: exact inner products, by lookups from the sign plane down."""
    bits, groups, rows = planes.shape
    out = np.zeros((rows, tables.shape[2]), tables.dtype)
    found = np.empty_like(out)
    for b in range(bits - 1, -1, -1):
        out += out
        for g in range(groups):
            np.take(tables[g], planes[b, g], axis=0, out=found)
            if b == bits - 1:
                out -= found
            else:
                out += found
    return out


def best(ranks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) of the ``n`` largest ranks of each row of [anchors, candidates]; NOTHING never counts."""
    if ranks.shape[1] > n:
        at = np.argpartition(ranks, ranks.shape[1] - n, axis=1)[:, -n:]
    else:
        at = np.broadcast_to(np.arange(ranks.shape[1]), ranks.shape)
    who = np.broadcast_to(np.arange(len(ranks))[:, None], at.shape)
    real = np.take_along_axis(ranks, at, 1) > NOTHING
    return who[real], at[real]


class Shape:
    """Width, bits and number type that hold every component and score; two numbers per column reach the driver."""

    def __init__(self, rows: DataFrame) -> None:
        self.n, width, low, high = rows.agg(F.count("*"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
        self.width = max(1, width or 1)
        reach = max(-(low or 0), (high or 0) + 1, 1)
        self.bits = int(reach - 1).bit_length() + 1
        most = self.width * reach * (1 << self.bits)
        if most >= 1 << 50:
            raise ValueError("components are too large for exact 64-bit scores")
        self.dtype = np.int32 if most < 1 << 31 else np.int64


def chunks(rows: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """Candidates as packed chunks of at most CHUNK rows, ordered by id; written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                some = batch.slice(start, CHUNK)
                ids, row, labels = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.lexsort((row, ids))
                planes = bit_planes(_matrix(some.column(3), shape.width)[order], shape.bits)
                fields = [ids[order].astype("<i8"), row[order].astype("<i8"), labels[order].astype("<i8"), planes]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in fields], ["ids", "rows", "labels", "planes"])

    dealt = rows.select("id", "row", "label", "vector").repartition(parts)
    return staged(dealt.mapInArrow(pack, CHUNKS), "chunks")


def blocks(anchors: DataFrame, shape: Shape, n: int) -> DataFrame:
    """Anchors (id, row, label, vector, bounds) as packed blocks of about BLOCK rows; bounds has POSITIVES numbers or fewer."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                ids, row, labels = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                sizes = some.column(4).value_lengths().to_numpy(zero_copy_only=False)
                bounds = np.full((some.num_rows, POSITIVES), NOTHING, np.int64)
                bounds[np.arange(POSITIVES) < sizes[:, None]] = some.column(4).flatten().to_numpy(zero_copy_only=False)
                fields = [ids.astype("<i8"), row.astype("<i8"), labels.astype("<i8"), _matrix(some.column(3), shape.width).astype(shape.dtype), bounds]
                yield pa.RecordBatch.from_arrays([pa.array([int(row.min())], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in fields]], ["block", "ids", "rows", "labels", "vectors", "bounds"])

    dealt = anchors.select("id", "row", "label", "vector", "bounds").repartition(max(1, -(-n // BLOCK)))
    return staged(dealt.mapInArrow(pack, BLOCKS), "blocks")


def matches(pieces: DataFrame, queries: DataFrame, shape: Shape, negatives: bool) -> DataFrame:
    """FOUND: of each chunk and anchor, the best rows of the same label, or those of other labels within each bound.

    The product goes through all chunks of a task for each of its blocks, so tables are made once per block and task.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, dtype: np.frombuffer(batch.column(name)[i].as_buffer(), dtype)  # noqa: B023, E731
                ids, rows, labels = get("ids", "<i8"), get("rows", "<i8"), get("labels", "<i8")
                a_ids, a_rows, a_labels = get("a_ids", "<i8"), get("a_rows", "<i8"), get("a_labels", "<i8")
                if held != (block := batch.column("block")[i].as_py()):
                    tables, held = subset_sums(get("vectors", shape.dtype).reshape(len(a_ids), -1), shape.dtype), block
                got = scores(tables, get("planes", np.uint8).reshape(shape.bits, -1, len(ids))).T.astype(np.int64)
                # ties go to the earlier row of the chunk, which has the smaller id
                rank = got * len(ids) + np.arange(len(ids) - 1, -1, -1)
                same = a_labels[:, None] == labels
                if negatives:
                    bounds = get("bounds", np.int64).reshape(-1, POSITIVES)
                    other = np.where(same, NOTHING, rank)
                    picks = []
                    for k in range(POSITIVES):
                        at = np.flatnonzero(bounds[:, k] > NOTHING)  # anchors with so many positives
                        top, some = bounds[at, k : k + 1], got[at]
                        who, what = best(np.where((LOW * top <= 100 * some) & (100 * some <= HIGH * top), other[at], NOTHING), NEGATIVES)
                        picks.append((k, at[who], what))
                else:
                    picks = [(0, *best(np.where(same & (a_rows[:, None] != rows), rank, NOTHING), POSITIVES))]
                for k, who, what in picks:
                    if len(who):
                        columns = [a_rows[who], a_ids[who], np.full(len(who), k, np.int32), ids[what], rows[what], got[who, what]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_row", "anchor_id", "bound", "id", "row", "score"])

    asking = queries.select("block", F.col("ids").alias("a_ids"), F.col("rows").alias("a_rows"), F.col("labels").alias("a_labels"), "vectors", "bounds")
    return asking.hint("shuffle_replicate_nl").crossJoin(pieces).mapInArrow(score, FOUND)


def first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best rows of each key, with their rank from 1; Spark cuts each task's rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``.  Rows without an id, a
    label or a vector, or with a component that is NULL or not finite, take no
    part.  Shorter vectors count as if they ended in zeros.  Equal scores go to
    the smaller id.  A row that repeats an id is a row of its own: it can be its
    double's positive, and two anchors of one id are mined one by one.  Anchors
    without positives, or without negatives in reach, give no rows, nor does an
    empty table.  Other columns are not read.  Components whose scores could
    leave 64 bits are an error.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    shape = Shape(rows)
    parts = max(1, min(4 * partitions_of(vectors), -(-shape.n // CHUNK)))
    pieces = chunks(rows, shape, parts)
    anchors = rows.filter(F.col("id") % every == 0)
    n = anchors.count()
    plain = blocks(anchors.withColumn("bounds", F.array().cast("array<bigint>")), shape, n)
    positives = staged(first(matches(pieces, plain, shape, False), ["anchor_row"], POSITIVES), "positives")
    bounds = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("bounds"))
    bounded = blocks(anchors.join(by_merge(bounds), "row"), shape, n)
    negatives = first(matches(pieces, bounded, shape, True), ["anchor_row", "bound"], NEGATIVES)
    chosen = positives.select("anchor_row", (F.col("rank") - 1).alias("bound"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = staged(negatives.join(by_merge(chosen), ["anchor_row", "bound"]), "negatives")
    discard(rows, pieces, plain, bounded)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_four_russians_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


OP13_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
   from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, s.id) qualify row_number() over w <= 5"""
