"""Passages that documents share, exactly or nearly, by collinear chaining of k-mer seeds.

Seeds are winnowed 5-word k-mers: every exact run of K + WINDOW - 1 = 20 words
holds one.  Each seed is tied to its first document, the one with the smallest
id that has it, so a passage that n documents share gives n matches a seed and
no pairs among them.  Where that ends in no passage, pairs of neighbouring seeds
are tied to the next document that has them, and so is every run of ``MIN_WORDS``
words around such a pair: an equal run is a passage, so no further round is due.  The matches of a document and a first document are chained:
the best chain ends at a match with the score of the best chain before it (both
positions smaller) less the cost of the gap, which is linear in the words
skipped on both sides; a Fenwick tree over the positions in the first document
gives that maximum in logarithmic time.  Chains are then aligned in
their gaps and cut where a wide gap is not alike; a passage is a run of a chain,
extended over equal words at its ends, of at least ``MIN_WORDS`` words of which
``SIMILARITY`` or more are aligned, and a chain can hold several.  Texts with the
same words are found by one hash besides, so copies of monotonous texts, whose
seeds all look alike, are whole passages too.

Words travel as 32-bit hashes, and only those of documents that have a chain: a
bitmap of fixed size tells the second pass over the texts which they are.  They
are shuffled once, into buckets, and stay there; chains are sent to them.  Most
chains lie on one diagonal: they carry one hash of the words between their ends
and ``MARGIN`` words around them, and are judged many at a time.  Chains that are
not alike in between, and those whose extension has not ended within the margin,
are aligned with all their words and a margin four times as wide, until each has
ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import buckets, is_empty, staged_by
from .common import bytes_of, discard, in_bitmap, key_bitmap, mix64, partitions_of, per_batch, run_starts, runs, staged, table
from .words import Words, chunks, powers, winnow

K = 5
WINDOW = 16
#: Words that a gap may have on either side before it costs more than a match gains; wider ones part a chain if less than half of them are equal.
GAP = 64
MIN_WORDS = 40
SIMILARITY = 0.8
#: Words around a chain that its first extension sees: an equal run longer than that holds a seed.
MARGIN = K + WINDOW - 1
DROP = 6
BITMAP_BITS = 24
#: Bytes of text whose words are hashed at a time: the arrays stay near the processor.
CHUNK = 1 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text): the id is the key where one row has it; other rows get keys below zero, so they come first."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    again = rows.groupBy("doc_id").count().filter("doc_id is null or doc_id < 0 or count > 1").select(F.col("doc_id").alias("again"))
    if not again.take(1):
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    marked = rows.join(staged(again, "again"), F.col("doc_id").eqNullSafe(F.col("again")) , "left").withColumn("n", F.monotonically_increasing_id())
    known = F.col("again").isNull() & F.col("doc_id").isNotNull() & (F.col("doc_id") >= 0)
    return staged(marked.select(F.when(known, F.col("doc_id")).otherwise(-1 - F.col("n")).alias("key"), "doc_id", "text"), "keyed")


def _whole(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of all words of each text, in order."""
    out, full = np.zeros(len(words.counts), np.uint64), words.counts > 0
    if full.any():
        place = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)
        out[full] = np.add.reduceat(hashes * powers(int(words.counts.max()))[place], words.first[:-1][full])
    return mix64(out).view(np.int64)


def seeds(rows: DataFrame, k: int, window: int) -> DataFrame:
    """(key, doc_id, n_words, whole, at): whole is a hash of all words; at has (h, pos, first) of the winnowed k-mers, first marking the first place of h."""

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, wholes, offsets, columns = bytes_of(part.column(2)), [], [], [], ([], [], [])
        for some in chunks(texts, CHUNK):
            words = Words(texts[some])
            hashes = words.hashes()
            wholes.append(_whole(words, hashes))
            grams, valid = words.grams(hashes, k)
            at = winnow(grams, valid, window)
            text, h = words.text[at], grams[at].view(np.int64)
            order = np.argsort(h, kind="stable")  # places of one h stay in order, so by text
            first = np.ones(len(at), bool)
            same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
            first[order[1:][same]] = False
            for column, values in zip(columns, (h, (at - words.first[text]).astype(np.int32), first), strict=True):
                column.append(values)
            counts.append(words.counts)
            offsets.append(np.bincount(text, minlength=len(words.counts)))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(offsets))]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["h", "pos", "first"])
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(wholes)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "doc_id", "n_words", "whole", "at"])

    return per_batch(rows, batch, "key bigint, doc_id bigint, n_words bigint, whole bigint, at array<struct<h:bigint,pos:int,first:boolean>>")


# ---------------------------------------------------------------- chaining


def chain(x: np.ndarray, y: np.ndarray, k: int = K, gap: int = GAP) -> list[np.ndarray]:
    """Chains (indices into the matches, in order) that together use each match at most once, best first.

    ``x`` is sorted; equal matches have been removed.
    """
    rate = k / (2 * gap)
    dx, dy = np.diff(x), np.diff(y)
    if len(x) == 1 or ((dx == dy) & (dx > 0) & (dx <= gap)).all():
        return [np.arange(len(x))]
    values, rank = np.unique(y, return_inverse=True)
    size = len(values)
    best, who = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    ranks, xs, ys = rank.tolist(), x.tolist(), y.tolist()
    i = 0
    while i < len(xs):
        stop = i
        while stop < len(xs) and xs[stop] == xs[i]:  # matches at one place do not follow each other
            j, top, link = ranks[stop], 0.0, -1
            here = rate * (xs[stop] + ys[stop])
            while j > 0:
                if best[j] - here > top:
                    top, link = best[j] - here, who[j]
                j -= j & -j
            score[stop], before[stop] = k + top, link
            stop += 1
        for m in range(i, stop):
            j, value = ranks[m] + 1, score[m] + rate * (xs[m] + ys[m])
            while j <= size:
                if value > best[j]:
                    best[j], who[j] = value, m
                j += j & -j
        i = stop
    used, out = [False] * len(xs), []
    for end in sorted(range(len(xs)), key=lambda m: (-score[m], m)):
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        if path:
            out.append(np.array(path[::-1]))
    return out


def _chains(batches: Iterator[pa.RecordBatch], k: int, gap: int) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, ["key", "head"], 50_000):
        key, head, x, y = (rows[c].to_numpy() for c in ("key", "head", "pos", "head_pos"))
        starts = run_starts([key, head])
        sizes = np.diff(np.append(starts, len(key)))
        dx, dy = np.diff(x), np.diff(y)
        broken = np.concatenate([[True], (dx != dy) | (dx <= 0) | (dx > gap)])
        broken[starts] = False
        simple = np.add.reduceat(broken.astype(np.int64), starts) == 0  # one chain, which needs no search
        paths, lengths = [np.flatnonzero(np.repeat(simple, sizes))], [sizes[simple]]
        for a, n in zip(starts[~simple], sizes[~simple], strict=True):
            some = [a + path for path in chain(x[a : a + n], y[a : a + n], k, gap)]
            paths += some
            lengths.append(np.array([len(path) for path in some]))
        at, ends = np.concatenate(paths), np.concatenate([[0], *lengths]).cumsum()
        first = at[ends[:-1]]
        off = (x[at] - y[at]) != np.repeat(x[first] - y[first], np.diff(ends))
        straight = np.add.reduceat(off.astype(np.int64), ends[:-1]) == 0
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[at], pa.int32())) for c in (x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(head[first]), *lists, pa.array(straight)], ["key", "head", "x", "y", "straight"])


# ---------------------------------------------------------------- alignment


def extend(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int, bool]:
    """Words to add, and equal ones among them, from the fronts of ``a`` and ``b``: the best prefix (+1 equal, -2 not) before the score has fallen by ``drop``; and whether it never fell."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
    score = score[: fallen[0]] if len(fallen) else score
    if not len(score) or score.max() <= 0:
        return 0, 0, not len(fallen)
    m = int(score.argmax()) + 1
    return m, int(same[:m].sum()), not len(fallen)


def _extended(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray, step: int, drop: int = DROP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``extend`` for many pairs: ``n`` words from ``at_a`` in ``a`` and from ``at_b`` in ``b`` on, backwards if ``step`` is -1."""
    words, equal, never = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.ones(len(n), bool)
    todo, width = np.flatnonzero(n > 0), 32
    while len(todo):  # most end within a few words, only the others are seen at full width
        width = min(width, int(n[todo].max()))
        seen, rest = np.arange(width), []
        for some in np.array_split(todo, len(todo) * width // (1 << 18) + 1):
            inside = seen < n[some, None]
            place = np.where(inside, step * seen, 0)
            same = inside & (a[at_a[some, None] + place] == b[at_b[some, None] + place])
            score = np.cumsum(np.where(same, 1, -2), axis=1, dtype=np.int32)
            fallen = inside & (np.maximum.accumulate(np.maximum(score, 0), axis=1) - score >= drop)
            fell = fallen.any(axis=1)
            stop = np.where(fell, fallen.argmax(axis=1), n[some])
            score = np.where(seen < stop[:, None], score, -1)
            best = score.argmax(axis=1)
            top = score[np.arange(len(some)), best]
            words[some] = np.where(top > 0, best + 1, 0)
            equal[some] = np.where(top > 0, (top + 2 * (best + 1)) // 3, 0)
            never[some] = ~fell
            rest.append(some[~fell & (n[some] > width)])
        todo, width = np.concatenate(rest), 4 * width
    return words, equal, never


def extend_all(a: pa.ListArray, b: pa.ListArray, backwards: bool, drop: int = DROP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``extend`` for each pair of lists, from their ends if ``backwards``."""
    offsets = [c.offsets.to_numpy().astype(np.int64) for c in (a, b)]
    n = np.minimum(*(np.diff(o) for o in offsets))
    at_a, at_b = (o[1:] - 1 if backwards else o[:-1] for o in offsets)
    return _extended(a.values.to_numpy(), at_a, b.values.to_numpy(), at_b, n, -1 if backwards else 1, drop)


def common_words(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while min(end_a, end_b) > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    places: dict[int, int] = {}
    for i in range(start, end_b):
        places[b[i]] = places.get(b[i], 0) | 1 << i - start
    full = (1 << end_b - start) - 1
    row = full  # a zero where the row grows
    for i in range(start, end_a):
        if hit := row & places.get(a[i], 0):
            row = (row + hit | row - hit) & full
    return start + len(a) - end_a + end_b - start - row.bit_count()


def _gap_words(one: list[int], two: list[int], gap: int) -> int:
    """Words of a gap that can be aligned; 0 for one that will part the chain: one side has too few words that the other has at all."""
    wide = max(len(one), len(two))
    if wide > gap and 2 * len(one) - 2 * sum(map(set(one).difference(two).__contains__, one)) < wide:
        return 0
    return common_words(one, two)


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K, gap: int = GAP, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, equal words) of the passages in a chain of k-mers at ``x`` in ``a`` and ``y`` in ``b``.

    Gaps of more than ``gap`` words on a side, of which less than half are equal,
    part the chain.  From each part the longest run that is a passage is taken,
    its ends extended over equal words, then the same from what is left before
    and after it, until nothing long or similar enough is left.
    """
    blocks: list[list[int]] = []  # x0, x1, y0, y1, equal words; k-mers that overlap count once
    between: list[int] = []  # equal words of the gap before each block but the first
    words_a, words_b = a.tolist(), b.tolist()
    for sx, sy in zip(x.tolist(), y.tolist(), strict=True):
        if not blocks:
            blocks.append([sx, sx + k, sy, sy + k, k])
            continue
        last = blocks[-1]
        px, py = last[1], last[3]
        shift = max(px - sx, py - sy, 0)
        if shift >= k:
            continue
        equal = 0 if shift else _gap_words(words_a[px:sx], words_b[py:sy], gap)
        if sx - px == sy - py and (shift or equal == sx - px):
            last[1], last[3], last[4] = sx + k, sy + k, last[4] + equal + k - shift
            continue
        blocks.append([sx + shift, sx + k, sy + shift, sy + k, k - shift])
        between.append(equal)
    x0, x1, y0, y1, inside = np.array(blocks).T
    wide = np.maximum(x0[1:] - x1[:-1], y0[1:] - y1[:-1])
    parted = np.flatnonzero((wide > gap) & (2 * np.array(between, np.int64) < wide)) + 1
    total = np.cumsum(inside + np.array([0, *between]))  # equal words up to the end of each block
    gain_front = lambda i: extend(a[x1[i - 1] if i else 0 : x0[i]][::-1], b[y1[i - 1] if i else 0 : y0[i]][::-1])[:2]
    gain_back = lambda i: extend(a[x1[i] : x0[i + 1] if i + 1 < len(x0) else len(a)], b[y1[i] : y0[i + 1] if i + 1 < len(y0) else len(b)])[:2]
    out, open_ = [], list(zip([0, *parted.tolist()], [*parted.tolist(), len(blocks)], strict=True))
    while open_:
        low, high = open_.pop()
        # no run is longer than all of it; only if that is no passage are the others looked at
        (m, m_equal), (n, n_equal) = gain_front(low), gain_back(high - 1)
        in_x, in_y = x1[high - 1] + n - x0[low] + m, y1[high - 1] + n - y0[low] + m
        equal = total[high - 1] - total[low] + inside[low] + m_equal + n_equal
        if in_x < min_words:
            continue
        if equal >= similarity * max(in_x, in_y):
            out.append((int(x0[low] - m), int(x1[high - 1] + n), int(y0[low] - m), int(y1[high - 1] + n), int(equal)))
            continue
        # what each block gains at its front and its end, up to the next blocks
        front, back = (np.array([[0, 0]] * low + [gain(i) for i in range(low, high)]) for gain in (gain_front, gain_back))
        longest, best = 0, None
        for i in range(low, high):
            in_x, in_y = (end[i:high] + back[i:high, 0] - (start[i] - front[i, 0]) for start, end in ((x0, x1), (y0, y1)))
            if in_x[-1] <= longest:
                break
            equal = total[i:high] - total[i] + inside[i] + front[i, 1] + back[i:high, 1]
            fits = np.flatnonzero((in_x >= max(min_words, longest + 1)) & (equal >= similarity * np.maximum(in_x, in_y)))
            if len(fits):
                j = int(fits[in_x[fits].argmax()])
                longest, best = int(in_x[j]), (i, i + j, int(equal[j]))
        if best is None:
            continue
        i, j, equal = best
        out.append((int(x0[i] - front[i, 0]), int(x1[j] + back[j, 0]), int(y0[i] - front[i, 0]), int(y1[j] + back[j, 0]), equal))
        open_ += [part for part in ((low, i), (j + 1, high)) if part[0] < part[1]]
    return sorted(out)


def _chain_words(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, k: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each chain, its equal words from end to end and whether a gap parts it, as in ``align``; chains start at ``first`` in the matches at ``x`` in ``a`` and ``y`` in ``b``."""
    follows = np.ones(len(x), bool)
    follows[first] = False
    i = np.flatnonzero(follows)  # each match but the first of a chain, with the one before
    dx, dy = x[i] - x[i - 1], y[i] - y[i - 1]
    in_x, in_y, shift = dx - k, dy - k, np.maximum(k - np.minimum(dx, dy), 0)
    equal = np.zeros(len(i), np.int64)
    level = np.flatnonzero((dx == dy) & (in_x > 0))
    if len(level):
        sizes = in_x[level]
        starts = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        after = i[level] - 1
        equal[level] = np.add.reduceat((a[np.repeat(x[after] + k, sizes) + place] == b[np.repeat(y[after] + k, sizes) + place]).astype(np.int64), starts)
    # words of a gap on one diagonal of which at most one differs are counted; others are aligned
    for j in np.flatnonzero((in_x > 0) & (in_y > 0) & ((dx != dy) | (equal < in_x - 1))).tolist():
        p, q = x[i[j] - 1] + k, y[i[j] - 1] + k
        equal[j] = _gap_words(a[p : p + in_x[j]].tolist(), b[q : q + in_y[j]].tolist(), gap)
    wide = np.maximum(in_x, in_y) + shift
    total, parts = np.full(len(x), k), np.zeros(len(x), np.int64)
    total[i] += equal - shift
    parts[i] = (wide > gap) & (2 * equal < wide)
    return np.add.reduceat(total, first), np.add.reduceat(parts, first) > 0


def _word_hashes(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, words): hashed words of the rows whose key is in the bitmap."""

    def batch(part: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = part.column(0).to_numpy()
        mine = np.flatnonzero(in_bitmap(bitmap, keys))
        if not len(mine):
            return None
        texts = bytes_of(part.column(1).take(pa.array(mine)))
        flat, counts = [], []
        for some in chunks(texts, CHUNK):
            words = Words(texts[some])
            flat.append((words.hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32))
            counts.append(words.counts)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys[mine]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))], ["key", "words"])

    return per_batch(rows.select("key", "text"), batch, "key bigint, words array<int>")


def _slice(words: str, low, high):
    return F.slice(words, low + 1, high - low)


def _open_pairs(batches: Iterator[pa.RecordBatch], k: int, reach: int) -> Iterator[pa.RecordBatch]:
    """(key, pos, step, pair): neighbouring shared seeds outside accepted passages, at most ``reach`` words apart, unless the document is the first one of both.

    Rows are (key, pos, stop, seed, head), sorted by key and pos; accepted passages have a stop and no seed.
    """
    for rows in runs(batches, ["key"], 50_000):
        key, pos, stop, seed, head = (rows[c].to_numpy() for c in ("key", "pos", "stop", "seed", "head"))
        of = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(np.int64) << 32
        reached = np.maximum.accumulate(of + stop)
        at = np.flatnonzero((stop == 0) & (of + pos + k > reached))
        i, j = at[:-1], at[1:]
        near = (key[i] == key[j]) & (pos[j] - pos[i] <= reach) & ((head[i] != key[i]) | (head[j] != key[j]))
        i, j = i[near], j[near]
        step = pos[j] - pos[i]
        pair = mix64(seed[i].view(np.uint64) + mix64(seed[j].view(np.uint64) + step.astype(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(pos[i]), pa.array(step), pa.array(pair)], ["key", "pos", "step", "pair"])


def _long_grams(part: pa.RecordBatch, k: int, size: int) -> pa.RecordBatch | None:
    """(key, pos, gram): hashes of the ``size`` words in a row that hold both seeds of a pair; rows are (key, pairs, words)."""
    keys, pairs, words = part.column(0).to_numpy(), part.column(1), part.column(2)
    ends, first, step = pairs.offsets.to_numpy(), pairs.values.field("pos").to_numpy(), pairs.values.field("step").to_numpy()
    word_ends, flat = words.offsets.to_numpy(), words.values.to_numpy()
    out = []
    for i in range(part.num_rows):
        a = mix64(flat[word_ends[i] : word_ends[i + 1]].astype(np.int64).view(np.uint64))
        n = len(a) - size + 1
        if n <= 0:
            continue
        mine = slice(ends[i], ends[i + 1])
        mark = np.zeros(n + 1, np.int64)
        low, high = np.maximum(first[mine] + step[mine] + k - size, 0), np.minimum(first[mine] + 1, n)
        some = low < high
        np.add.at(mark, low[some], 1)
        np.add.at(mark, high[some], -1)
        at = np.flatnonzero(np.cumsum(mark)[:n])
        gram = np.zeros(len(at), np.uint64)
        for j, p in enumerate(powers(size)):
            gram += a[at + j] * p
        out.append((np.full(len(at), keys[i]), at.astype(np.int32), mix64(gram).view(np.int64)))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "pos", "gram"])


def _tied(places: DataFrame, of: str, *columns: str) -> DataFrame:
    """(key, head, pos, head_pos, columns): the places of each value of ``of`` that several documents have, with the first document and place that has it; the places in that document too."""
    first = places.groupBy(F.col(of).alias("of")).agg(F.min("key").alias("head"), F.max("key").alias("last"), F.min(F.struct("key", "pos")).alias("at"))
    first = first.filter("head < last").select("of", "head", F.col("at.pos").alias("head_pos"))
    return places.join(first, F.col(of) == F.col("of")).select("key", "head", "pos", "head_pos", *columns)


def _chained(matches: DataFrame, k: int) -> DataFrame:
    """(key, head, x, y, straight): chains of (key, head, pos, head_pos); straight ones lie on one diagonal."""
    sorted_matches = matches.repartition(partitions_of(matches), "key").sortWithinPartitions("key", "head", "pos", "head_pos")
    return staged(sorted_matches.mapInArrow(lambda it: _chains(it, k, GAP), "key bigint, head bigint, x array<int>, y array<int>, straight boolean"), "chains")


_PLACED = "key bigint, head bigint, x0 int, x1 int, y0 int, y1 int, equal int, left boolean"


def _straight(found: DataFrame, words: DataFrame, heads: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """Passages of straight chains whose words are all equal; ``left`` marks (by x0 and y0) the chains that need all their words."""
    x0, x1, y0 = F.get("x", 0), F.element_at("x", -1) + k, F.get("y", 0)
    ends = found.select("key", "head", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), F.least(x0, y0, F.lit(MARGIN)).alias("front"))
    inner = lambda w, low, high: F.xxhash64(_slice(w, low, high))
    one = ends.join(words, "key").select(
        "key", "head", "x0", "x1", "y0", "front", (F.size("words") - F.col("x1")).alias("after"), inner("words", F.col("x0"), F.col("x1")).alias("inner"),
        _slice("words", F.col("x0") - F.col("front"), F.col("x0")).alias("a_front"), _slice("words", F.col("x1"), F.col("x1") + MARGIN).alias("a_back"),
    )
    y1 = F.col("y0") + F.col("x1") - F.col("x0")
    two = one.join(heads, F.col("head") == F.col("head_key")).select(
        "key", "head", "x0", "x1", "y0", (F.col("inner") == inner("head_words", F.col("y0"), y1)).alias("same"), F.least(F.col("after"), F.size("head_words") - y1).alias("after"),
        "a_front", _slice("head_words", F.col("y0") - F.col("front"), F.col("y0")).alias("b_front"), "a_back", _slice("head_words", y1, y1 + MARGIN).alias("b_back"),
    )

    def batch(part: pa.RecordBatch) -> pa.RecordBatch | None:
        x0, x1, y0, after = (part.column(c).to_numpy() for c in ("x0", "x1", "y0", "after"))
        m, m_equal, m_open = extend_all(part.column("a_front"), part.column("b_front"), True)
        n, n_equal, n_open = extend_all(part.column("a_back"), part.column("b_back"), False)
        left = ~part.column("same").to_numpy(zero_copy_only=False) | (m_open & (np.minimum(x0, y0) > MARGIN)) | (n_open & (after > MARGIN))
        length, equal = x1 - x0 + m + n, x1 - x0 + m_equal + n_equal
        keep = np.flatnonzero(left | ((length >= min_words) & (equal >= similarity * length)))
        if not len(keep):
            return None
        first, first_y = np.where(left, x0, x0 - m), np.where(left, y0, y0 - m)
        columns = [pa.array(c[keep], pa.int32()) for c in (first, first + length, first_y, first_y + length, equal)]
        at = pa.array(keep)
        return pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("head").take(at), *columns, pa.array(left[keep])], ["key", "head", "x0", "x1", "y0", "y1", "equal", "left"])

    return per_batch(two, batch, _PLACED)


def aligned_all(part: pa.RecordBatch, k: int = K, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> pa.RecordBatch | None:
    """Passages of many chains, each as ``align`` has them; those that a gap parts, or that are no passage from end to end, go through it one by one.

    Rows are (key, head, x, y, low_x, low_y, more, a, b): ``a`` and ``b`` hold the words from ``low_x`` and ``low_y`` on, and both documents have more if ``more``.
    """
    flat, starts, sizes = {}, {}, {}
    for c in ("x", "y", "a", "b"):
        ends = part.column(c).offsets.to_numpy().astype(np.int64)
        flat[c], starts[c], sizes[c] = part.column(c).flatten().to_numpy(), ends[:-1] - ends[0], np.diff(ends)
    low_x, low_y, more = (part.column(c).to_numpy(zero_copy_only=False) for c in ("low_x", "low_y", "more"))
    a, b, first, last = flat["a"], flat["b"], starts["x"], starts["x"] + sizes["x"] - 1
    # matches by their places in the words of all chains
    x, y = (flat[c] + np.repeat(starts[w] - low, sizes[c]) for c, w, low in (("x", "a", low_x), ("y", "b", low_y)))
    m, m_equal, m_open = _extended(a, x[first] - 1, b, y[first] - 1, np.minimum(x[first] - starts["a"], y[first] - starts["b"]), -1)
    after = np.minimum(starts["a"] + sizes["a"] - x[last], starts["b"] + sizes["b"] - y[last]) - k
    n, n_equal, n_open = _extended(a, x[last] + k, b, y[last] + k, after, 1)
    left = ((low_x > 0) & (low_y > 0) & m_open) | (more & n_open)
    ended = np.flatnonzero(~left)
    equal, parted = m_equal + n_equal, np.zeros(len(left), bool)
    if len(ended):
        mine = np.repeat(~left, sizes["x"])
        inner, parted[ended] = _chain_words(a, b, x[mine], y[mine], np.cumsum(sizes["x"][ended]) - sizes["x"][ended], k, GAP)
        equal[ended] += inner
    x0, x1, y0, y1 = x[first] - starts["a"] - m, x[last] - starts["a"] + k + n, y[first] - starts["b"] - m, y[last] - starts["b"] + k + n
    alike = equal >= similarity * np.maximum(x1 - x0, y1 - y0)
    # a chain that is no passage from end to end may hold some
    inside = np.flatnonzero(~left & (parted | ((x1 - x0 >= min_words) & ~alike)))
    keep = np.flatnonzero(left | (~parted & alike & (x1 - x0 >= min_words)))
    at, columns = [keep], [[np.where(left, x[first] - starts["a"], x0)[keep], x1[keep], np.where(left, y[first] - starts["b"], y0)[keep], y1[keep], equal[keep]]]
    for i in inside.tolist():
        own = slice(first[i], last[i] + 1)
        words_a, words_b = (flat[w][starts[w][i] : starts[w][i] + sizes[w][i]] for w in ("a", "b"))
        if found := align(words_a, words_b, x[own] - starts["a"][i], y[own] - starts["b"][i], k, GAP, min_words, similarity):
            at.append(np.full(len(found), i))
            columns.append(list(np.array(found).T))
    at = np.concatenate(at)
    if not len(at):
        return None
    x0, x1, y0, y1, equal = (np.concatenate(c) for c in zip(*columns, strict=True))
    numbers = [pa.array(c, pa.int32()) for c in (x0 + low_x[at], x1 + low_x[at], y0 + low_y[at], y1 + low_y[at], equal)]
    return pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at)), part.column("head").take(pa.array(at)), *numbers, pa.array(left[at])], ["key", "head", "x0", "x1", "y0", "y1", "equal", "left"])


def _aligned(found: DataFrame, words: DataFrame, heads: DataFrame, margin: int, k: int, min_words: int, similarity: float) -> DataFrame:
    """Passages of chains; ``left`` marks (by x0 and y0) the chains whose extension has not ended within ``margin`` words."""
    low_x, high_x = F.greatest(F.get("x", 0) - margin, F.lit(0)), F.element_at("x", -1) + k + margin
    low_y, high_y = F.greatest(F.get("y", 0) - margin, F.lit(0)), F.element_at("y", -1) + k + margin
    one = found.join(words, "key").select("key", "head", "x", "y", low_x.alias("low_x"), low_y.alias("low_y"), high_y.alias("high_y"), (F.size("words") > high_x).alias("more"), _slice("words", low_x, high_x).alias("a"))
    two = one.join(heads, F.col("head") == F.col("head_key")).select(
        "key", "head", "x", "y", "low_x", "low_y", (F.col("more") & (F.size("head_words") > F.col("high_y"))).alias("more"), "a", _slice("head_words", F.col("low_y"), F.col("high_y")).alias("b")
    )

    return per_batch(two, lambda part: aligned_all(part, k, min_words, similarity), _PLACED)


def _placed(found: DataFrame, words: DataFrame, k: int, min_words: int, similarity: float) -> DataFrame:
    """(key, head, x0, x1, y0, y1, equal): the passages of chains, each extended until it ends."""
    named = found.select(F.col("head").alias("head_key")).distinct()
    heads = staged(words.withColumnRenamed("words", "head_words").join(named, F.col("key") == F.col("head_key")).select("head_key", "head_words"), "head_words")

    def left_of(chains: DataFrame, tried: DataFrame) -> DataFrame:
        on = tried.filter("left").select(F.col("key").alias("l_key"), F.col("head").alias("l_head"), F.col("x0").alias("l_x"), F.col("y0").alias("l_y"))
        same = (F.col("key") == F.col("l_key")) & (F.col("head") == F.col("l_head")) & (F.get("x", 0) == F.col("l_x")) & (F.get("y", 0) == F.col("l_y"))
        return chains.join(on, same, "left_semi")

    tried = staged(_straight(found.filter("straight"), words, heads, k, min_words, similarity), "straight")
    parts, used, margin = [tried], [heads], MARGIN
    rest = staged(found.filter("not straight").unionByName(left_of(found.filter("straight"), tried)), "rest")
    while not is_empty(rest):
        margin *= 4
        tried = staged(_aligned(rest, words, heads, margin, k, min_words, similarity), "aligned")
        parts.append(tried)
        used.append(rest)
        rest = staged(left_of(rest, tried), "rest")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    result = staged(result.filter("not left").drop("left"), "placed")
    discard(*parts, *used, rest)
    return result


def passages(rows: DataFrame, seeded: DataFrame, k: int = K, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, head, x0, x1, y0, y1, equal): passages of ``key`` that its first document ``head`` has too; word positions, ends exclusive."""
    places = seeded.select("key", F.inline("at"))
    by_seed = places.groupBy("h").agg(F.min("key").alias("head"), F.max("key").alias("last"), F.min_by("pos", F.when(F.col("first"), F.col("key"))).alias("head_pos"))
    shared = staged(by_seed.filter("head < last").select(F.col("h").alias("seed"), "head", "head_pos"), "shared")
    tied = staged(places.join(shared, F.col("h") == F.col("seed")).select("key", "head", "pos", "head_pos", "seed"), "tied")
    discard(shared)
    found = _chained(tied.filter("key <> head").drop("seed"), k)
    ends = found.select("key").unionByName(found.select(F.col("head").alias("key")))
    hashed = _word_hashes(rows, key_bitmap(ends, BITMAP_BITS))
    words = staged_by(hashed.repartition(buckets(rows.sparkSession), "key"), "key", "words")
    result = _placed(found, words, k, min_words, similarity)
    discard(found)
    # seeds in no accepted passage: their pairs are tied to the next document, and so are the runs of min_words around them, where equal runs are passages
    spans = result.select("key", F.col("x0").alias("pos"), F.col("x1").alias("stop"), F.lit(0).cast("bigint").alias("seed"), "head")
    rest = tied.select("key", "pos", F.lit(0).alias("stop"), "seed", "head").unionByName(spans)
    in_order = rest.repartition(partitions_of(rows), "key").sortWithinPartitions("key", "pos")
    pairs = staged(in_order.mapInArrow(lambda it: _open_pairs(it, k, WINDOW), "key bigint, pos int, step int, pair bigint"), "pairs")
    open_pairs = staged(_tied(pairs, "pair", "step"), "open_pairs")
    discard(pairs)
    by_key = open_pairs.groupBy("key").agg(F.collect_list(F.struct("pos", "step")).alias("pairs"))
    with_words = by_key.join(words, "key").select("key", "pairs", "words")
    grams = staged(per_batch(with_words, lambda part: _long_grams(part, k, min_words), "key bigint, pos int, gram bigint"), "grams")
    both = lambda df, step: df.select("key", "head", F.explode(F.array(F.lit(0), step)).alias("step"), "pos", "head_pos").select("key", "head", (F.col("pos") + F.col("step")).alias("pos"), (F.col("head_pos") + F.col("step")).alias("head_pos"))
    again = both(open_pairs, F.col("step")).unionByName(both(_tied(grams, "gram"), F.lit(min_words - k)))
    later = _chained(again.filter("key <> head").distinct(), k)
    aligned = result.unionByName(_placed(later, words, k, min_words, similarity))
    heads = staged(seeded.filter(f"n_words >= {min_words}").groupBy("whole").agg(F.min("key").alias("head")).withColumnRenamed("whole", "of"), "heads")
    n = F.col("n_words").cast("int")
    zero = F.lit(0)
    copies = seeded.join(heads, F.col("whole") == F.col("of")).filter("key <> head").select(
        "key", "head", zero.alias("x0"), n.alias("x1"), zero.alias("y0"), n.alias("y1"), n.alias("equal")
    )
    result = staged(aligned.unionByName(copies).dropDuplicates(["key", "head", "x0", "x1", "y0", "y1"]), "passages")
    discard(tied, words, open_pairs, grams, heads, later)
    return result


def _covered(spans: DataFrame, name: str) -> DataFrame:
    """(owner, name): number of words inside the (owner, low, high) spans."""
    reached = F.expr("coalesce(max(high) over (partition by owner order by low, high rows between unbounded preceding and 1 preceding), 0)")
    return spans.distinct().withColumn("reached", reached).groupBy("owner").agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", "reached"))).cast("bigint").alias(name))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, repeats, n_words, n_again, n_shared, n_links, passages).

    class_id: the smallest id among the earlier documents it shares passages
    with, or its own; repeats: whether it shares any passage, earlier or later.
    n_again: words in passages that a document with a smaller id has too;
    n_shared: those, and words in passages that later documents have from this
    one; n_links: earlier documents it shares passages with; passages: their
    ``start:end:doc_id:start:end`` in word positions, by start.

    NULL, empty and short texts share nothing.  Rows without an id, and rows
    that repeat one, are documents of their own and count as earlier than all
    others.  An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    seeded = staged(seeds(rows, K, WINDOW), "seeds")
    found = passages(rows, seeded)
    again = found.select(F.col("key").alias("owner"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    given = found.groupBy(F.col("head").alias("owner"), F.col("y0").alias("low"), F.col("y1").alias("high")).count().drop("count")
    # a key from zero on is the id itself; only keys given to repeated rows are looked up
    names = seeded.filter("key < 0").select(F.col("key").alias("head_key"), F.col("doc_id").alias("head_id"))
    looked_up = found.filter("head < 0").join(names, F.col("head") == F.col("head_key")).drop("head_key")
    named = found.filter("head >= 0").withColumn("head_id", F.col("head")).unionByName(looked_up)
    entry = F.struct("x0", "x1", F.concat_ws(":", "x0", "x1", F.coalesce(F.col("head_id").cast("string"), F.lit("")), "y0", "y1").alias("text"))
    listed = named.groupBy(F.col("key").alias("owner")).agg(
        F.size(F.collect_set("head")).alias("n_links"), F.min("head_id").alias("class_id"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["text"])).alias("passages")
    )
    per_row = staged(_covered(again, "n_again").join(_covered(again.unionByName(given), "n_shared"), "owner", "full").join(listed, "owner", "left"), "per_row")
    return seeded.select("key", "doc_id", "n_words").join(per_row, F.col("key") == F.col("owner"), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("n_shared", F.lit(0)) > 0).alias("repeats"),
        "n_words", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_again", "n_shared", "n_links")], F.coalesce("passages", F.lit("")).alias("passages"),
    )


def op9_chained_passages(spark, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))
