"""SimHash near-duplicates found by the generalised pigeonhole principle.

A fingerprint has 64 bits; two texts are linked if their fingerprints differ in
at most ``TAU`` bits.  The bits are divided into partitions, correlated bits
together, so that the other partitions stay selective.  If per-partition
thresholds t_1..t_m satisfy sum(t_i) = TAU - m + 1 (t_i = -1 means: do not look
there), two linked fingerprints agree up to t_i bits in at least one partition.
Every fingerprint gets thresholds of its own, by dynamic programming on
estimated candidate counts, and probes the buckets within them.

Equal fingerprints are one node.  Buckets larger than ``BLOCK`` rows are cut
into blocks, and each pair of blocks is a group of its own; a group emits a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, fresh, partitions_of, per_batch, run_starts, runs, staged, table, text_key, without_rows
from .components import connected_components

TAU = 3
SHINGLE = 3
SEED = 42
PARTS = 4
BLOCK = 2048
#: A bucket value is kept in the histogram if it holds more than this share of the nodes; so at most 16 384 a partition.
HEAVY_SHARE = 1 / 16384


def simhash64(text: bytes | None, k: int = SHINGLE) -> int:
    """Fingerprint of one text: bit set if it is set in over half of the shingle hashes; 0 without words."""
    if not text:
        return 0
    words = text.lower().split()  # bytes.lower() touches A-Z only, bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    hashed = xxhash.xxh64_digest
    packed = b"".join([hashed(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)])
    count, n = np.zeros(64, np.int64), len(starts)
    raw = np.frombuffer(packed, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        count += np.unpackbits(raw[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): one row per input row, with its text key; a NULL or empty text has fingerprint 0."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash64(x) for x in bytes_of(rows.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(fp)], ["doc_id", "key", "fp"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    return per_batch(slim, batch, "doc_id bigint, key bigint, fp bigint")


# ---------------------------------------------------------------- partitions of the bits


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and in how many of them each pair of bits is set (64 x 64)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for rows in batches:
            fp = rows.column(0).to_numpy().view(np.uint64)
            bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        if n:
            i, j = np.triu_indices(64)
            keys, sums = [-1, *(i * 64 + j).tolist()], [n, *total[i, j].astype(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(sums, pa.int64())], ["pair", "n"])

    sums = {r.pair: r.n for r in nodes.select("fp").mapInArrow(partial, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((64, 64))
    for pair, n in sums.items():
        if pair >= 0:
            both[pair // 64, pair % 64] = both[pair % 64, pair // 64] = n
    return sums.get(-1, 0), both


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits (0 = highest) by partition: each is opened by the free bit most tied to others, and filled by correlation."""
    if not n:
        return [list(range(i * 64 // parts, (i + 1) * 64 // parts)) for i in range(parts)]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        room = 64 * (i + 1) // parts - 64 * i // parts
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < room:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(n, parts) values of the partitions of unsigned fingerprints."""
    out = np.zeros((len(fp), len(groups)), np.int64)
    for i, bits in enumerate(groups):
        for b in bits:
            out[:, i] = (out[:, i] << 1) | ((fp >> np.uint64(63 - b)) & np.uint64(1)).astype(np.int64)
    return out


# ---------------------------------------------------------------- thresholds


def masks(width: int, t: int) -> np.ndarray:
    """Every change of at most t of ``width`` bits, the empty one first."""
    out = [0]
    for r in range(1, t + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(out, np.int64)


def allocate(values: np.ndarray, counts: list[np.ndarray], widths: list[int], tau: int = TAU) -> np.ndarray:
    """(n, parts) thresholds of least estimated cost (probes + candidates) with sum tau - parts + 1."""
    n, parts = values.shape
    target = tau - parts + 1
    own = np.stack([counts[i][values[:, i]] for i in range(parts)], axis=1).astype(np.float64)
    chosen = np.zeros((n, parts), np.int64)
    hard = np.arange(n)
    if target == 0:  # exact look-ups everywhere cost this much; any other choice needs a radius-1 search at least
        hard = np.flatnonzero(own.sum(axis=1) + parts > 1 + min(widths))
    if not len(hard):
        return chosen
    v = values[hard]
    top = min(tau, target + parts - 1)
    cost = np.zeros((parts, top + 2, len(hard)))  # by partition, threshold + 1, row
    for i in range(parts):
        radius = [len(masks(widths[i], t)) for t in range(top + 1)]
        for start in range(0, len(hard), 4096):
            rows = v[start : start + 4096, i]
            near = np.cumsum(counts[i][rows[:, None] ^ masks(widths[i], top)[None, :]], axis=1)
            for t in range(top + 1):
                cost[i, t + 1, start : start + 4096] = radius[t] + near[:, radius[t] - 1]
    # Dynamic programming: best[s] over the first partitions whose thresholds + 1 add up to s.
    goal = target + parts
    best = np.full((goal + 1, len(hard)), np.inf)
    best[0] = 0
    taken = np.zeros((parts, goal + 1, len(hard)), np.int64)
    for i in range(parts):
        after = np.full_like(best, np.inf)
        for s in range(goal + 1):
            for t in range(min(s, top + 1) + 1):
                c = best[s - t] + cost[i, t]
                better = c < after[s]
                after[s][better] = c[better]
                taken[i, s][better] = t
        best = after
    s, cols = np.full(len(hard), goal), np.arange(len(hard))
    for i in reversed(range(parts)):
        t = taken[i, s, cols]
        chosen[hard, i] = t - 1
        s = s - t
    return chosen


def probes(nodes: DataFrame, groups: list[list[int]], heavy: list[tuple[int, int, int]], n: int, tau: int = TAU) -> DataFrame:
    """(part, value, fp, asks): each node in its own buckets, and in those it must look at besides."""
    widths = [len(g) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.full(1 << w, max(1, n >> w), np.int64) for w in widths]
        for part, value, count in heavy:
            counts[part][value] = count
        for rows in batches:
            fp = rows.column(0).to_numpy()
            values = part_values(fp.view(np.uint64), groups)
            t = allocate(values, counts, widths, tau)
            out = [[np.full(len(fp), i), values[:, i], fp, t[:, i] >= 0] for i in range(len(groups))]
            for i, w in enumerate(widths):
                for r in range(1, int(t[:, i].max(initial=0)) + 1):
                    at = np.flatnonzero(t[:, i] == r)
                    around = values[at, i][:, None] ^ masks(w, r)[None, 1:]
                    k = around.shape[1]
                    out.append([np.full(len(at) * k, i), around.ravel(), np.repeat(fp[at], k), np.ones(len(at) * k, bool)])
            part, value, who, asks = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(value), pa.array(who), pa.array(asks)], ["part", "value", "fp", "asks"])

    return nodes.select("fp").mapInArrow(run, "part int, value bigint, fp bigint, asks boolean")


# ---------------------------------------------------------------- verification


def forest(fp: np.ndarray, tau: int = TAU) -> np.ndarray:
    """(2, k) spanning forest of the links among ``fp``: whatever a node reaches is not compared again."""
    free, edges = np.unique(fp.view(np.uint64)), []
    while len(free) > 1:
        front, free = [free[0]], free[1:]
        while front and len(free):
            x = front.pop()
            near = np.bitwise_count(free ^ x) <= tau
            edges.append(np.stack([np.full(near.sum(), x), free[near]]))
            front += list(free[near])
            free = free[~near]
    return np.concatenate(edges, axis=1).view(np.int64) if edges else np.zeros((2, 0), np.int64)


def _links(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    keys = ["part", "value", "low", "high"]
    for rows in runs(batches, keys):
        fp, asks = rows["fp"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
        starts = run_starts([rows[k].to_numpy() for k in keys])
        sizes = np.diff(np.append(starts, len(fp)))
        small = np.repeat(sizes <= 32, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        for shift in range(1, int(min(32, sizes.max(initial=1)))):
            x, y = fp[:-shift], fp[shift:]
            ok = small[:-shift] & (group[:-shift] == group[shift:]) & (asks[:-shift] | asks[shift:]) & (x != y)
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count((x[at] ^ y[at]).view(np.uint64)) <= tau]  # of signed numbers it would count the absolute value
            a.append(x[at])
            b.append(y[at])
        for g in np.flatnonzero(sizes > 32):
            part = slice(starts[g], starts[g] + sizes[g])
            if asks[part].any():
                x, y = forest(fp[part], tau)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def hamming_links(nodes: DataFrame, tau: int = TAU, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints of ``nodes`` (column ``fp``) that join all that are within ``tau`` bits."""
    n, both = bit_counts(nodes)
    groups = group_bits(n, both, parts)
    frame = nodes.select("fp")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            v = part_values(rows.column(0).to_numpy().view(np.uint64), groups)
            part = np.repeat(np.arange(len(groups)), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(v.T.ravel())], ["part", "value"])

    least = max(4, int(n * HEAVY_SHARE))
    heavy = [tuple(r) for r in frame.mapInArrow(own, "part int, value bigint").groupBy("part", "value").count().filter(F.col("count") > least).collect()]
    rows = staged(probes(frame, groups, heavy, n, tau), "probes")
    crowded = (
        rows.groupBy("part", "value").count().filter(F.col("count") > block)
        .select(F.col("part").alias("p"), F.col("value").alias("v"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    crowded = staged(crowded, "crowded")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(crowded, (F.col("part") == F.col("p")) & (F.col("value") == F.col("v")), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter("blocks = 1 or other <> mine")
        .select("part", "value", "fp", "asks", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    )
    keys = ["part", "value", "low", "high"]
    sorted_rows = dealt.repartition(partitions_of(nodes), *keys).sortWithinPartitions(*keys)
    links = staged(sorted_rows.mapInArrow(lambda it: _links(it, tau), "a bigint, b bigint"), "links")
    discard(rows, crowded)
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str, tau: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, key, fp), and (class_fp, component_id, root) of every fingerprint; root names the component."""
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = hamming_links(nodes, tau)
    roots = connected_components(links)
    named = roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "first_id")
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(firsts, "root").select(F.col("fp").alias("linked_fp"), F.col("component_id").alias("linked_id"), "root")
    linked = staged(linked, "linked")
    classes = nodes.join(linked, F.col("fp") == F.col("linked_fp"), "left")
    return marked, staged(classes.select(F.col("fp").alias("class_fp"), F.coalesce("linked_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id linked over any number of steps.

    A NULL text counts as empty and links like any other; repeated rows stay, very
    long texts count whole, and other columns are not read.
    Rows with a NULL doc_id take part but are never the smallest (component_id is
    NULL if a whole component has none).  An empty table gives an empty result.
    """
    marked, classes = _classes(docs, id_col, text_col, tau)
    return marked.join(classes, marked.fp == classes.class_fp).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """One row of each component, with all columns of ``docs``, whatever their names.

    The row with the smallest id stays, those without an id last; of rows that
    share it, one by the hash of its text, so rows of one id are told apart.  Of
    rows that repeat id and text, any one stays.  NULL and empty texts are one
    component.  An empty table gives no rows.
    """
    marked, classes = _classes(docs, id_col, text_col, tau)
    rows = marked.join(classes, marked.fp == classes.class_fp).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    rows = staged(rows, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = rows.groupBy("root").agg(F.min(place).alias("first")).select("root", "first.doc_id", "first.key", F.lit(True).alias("stays"))
    met = rows.alias("r").join(firsts.alias("f"), F.expr("r.root = f.root and r.key = f.key and r.doc_id <=> f.doc_id"), "left")
    told = staged(met.select("r.doc_id", "r.key", "r.n", F.coalesce("f.stays", F.lit(False)).alias("stays")), "told")
    kept = without_rows(docs, told.filter("not stays or n > 1").select("doc_id", "key"), id_col, text_col)
    again = told.filter("stays and n > 1")
    if again.take(1):
        again_id, again_key, hashed = fresh(docs, "again_id", "again_key", "hashed")
        again = again.select(F.col("doc_id").alias(again_id), F.col("key").alias(again_key))
        same = F.col(id_col).cast("bigint").eqNullSafe(F.col(again_id)) & (F.col(hashed) == F.col(again_key))
        repeated = docs.withColumn(hashed, text_key(text_col)).join(again, same, "left_semi").dropDuplicates([id_col, hashed])
        kept = kept.unionByName(repeated.select(*docs.columns))
    return kept


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
