import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.llm import passages as P
from linkloom.llm.words import winnow


def fresh(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]


def test_planted_passages(make_docs):
    rng = random.Random(9)
    exact, fuzzy = fresh(rng, 55), fresh(rng, 120)
    docs = []
    for i in range(40):
        words = fresh(rng, 100)
        if i % 4 == 1:
            words[30:30] = exact
        if i % 4 == 2:
            changed = [w if k % 12 else "changed" + str(i) for k, w in enumerate(fuzzy)]
            words[10:10] = changed[:60] + ["inserted", "words"] * (i % 3) + changed[60:]
        docs.append((i, " ".join(words)))
    rows = {r.doc_id: r for r in P.shared_passages(make_docs(docs).withColumn("key", F.lit("x")).withColumn("head", F.lit(1))).collect()}
    for i in range(40):
        r, first = rows[i], i == i % 4
        if i % 4 in (0, 3):
            assert (r.n_again, r.n_shared, r.n_links, r.passages) == (0, 0, 0, "")
        elif i % 4 == 1:
            assert r.n_shared == 55 and r.n_again == (0 if first else 55)
            assert ("30:85:1:30:85" in r.passages.split(",")) != first  # seeds at the edges may tie it to others too
        else:
            assert 105 <= r.n_shared <= 130 and (first or r.n_again == r.n_shared)


def test_odd_rows(make_docs, odd_texts):
    rows = P.shared_passages(make_docs(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (8, None)}
    assert all(by_id[i].n_shared == 0 for i in (1, 2, 3, 4, 5, 9, 10))
    assert by_id[7].n_again > 0.99 * by_id[7].n_words and by_id[6].n_again == 0
    text = " ".join(fresh(random.Random(1), 90))
    same = P.shared_passages(make_docs([(5, text), (5, text), (None, text), (6, text)])).collect()
    assert sorted(r.n_again for r in same) == [0, 90, 90, 90]
    assert P.shared_passages(make_docs([])).collect() == []


def brute_best(x, y, k, gap):
    """Score of the best chain by trying all of them."""
    rate, best = k / (2 * gap), 0.0
    for n in range(1, len(x) + 1):
        for c in itertools.combinations(range(len(x)), n):
            if all(x[a] < x[b] and y[a] < y[b] for a, b in itertools.pairwise(c)):
                best = max(best, k * n - rate * sum(x[b] - x[a] + y[b] - y[a] for a, b in itertools.pairwise(c)))
    return best


def test_best_chain_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(150):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 120, (int(rng.integers(1, 9)), 2))})
        x, y = np.array(pairs).T
        paths = P.chain(x, y, 5, 40)
        assert sorted(i for p in paths for i in p.tolist()) == list(range(len(x)))
        first = paths[0]
        score = 5 * len(first) - 5 / 80 * (np.diff(x[first]).sum() + np.diff(y[first]).sum())
        assert np.isclose(score, brute_best(x.tolist(), y.tolist(), 5, 40))


def test_alignment_counts_common_words():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 9)
        table = np.zeros((13, 10), int)
        for i, j in itertools.product(range(12), range(9)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert P.common_words(a, b) == table[-1, -1]


def test_several_passages_of_one_pair(make_docs):
    """Header and footer of 55 equal words around bodies of other words: each is a passage, whatever lies between."""
    rng = random.Random(12)
    for body in (30, 100, 200):
        docs = []
        for pair in range(6):
            header, footer = fresh(rng, 55), fresh(rng, 55)
            docs += [(2 * pair + i, " ".join(fresh(rng, 20) + header + fresh(rng, body) + footer + fresh(rng, 20))) for i in (0, 1)]
        rows = {r.doc_id: r for r in P.shared_passages(make_docs(docs)).collect()}
        for i in range(1, 12, 2):
            spans = f"20:75:{i - 1}:20:75,{75 + body}:{130 + body}:{i - 1}:{75 + body}:{130 + body}"
            assert (rows[i].n_again, rows[i].n_links, rows[i].passages) == (110, 1, spans)
            assert rows[i - 1].n_shared == 110


def test_cut_chains_against_all_runs():
    """What align() takes first is the longest run of matches that is long and similar enough."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b, x, y = [], [], [], []
        for _ in range(int(rng.integers(2, 9))):
            same = rng.integers(0, 1 << 30, int(rng.integers(5, 40))).tolist()
            x += range(len(a), len(a) + len(same) - 4)
            y += range(len(b), len(b) + len(same) - 4)
            a += same + rng.integers(0, 1 << 30, int(rng.integers(1, 30))).tolist()
            b += same + rng.integers(0, 1 << 30, int(rng.integers(1, 30))).tolist()
        starts = [i for i in range(len(x)) if i == 0 or x[i] != x[i - 1] + 1]
        ends = [i - 1 for i in starts[1:]] + [len(x) - 1]
        runs = [(x[i], x[j] + 5, y[i], y[j] + 5, sum(x[q] + 5 - x[p] for p, q in zip(starts, ends) if i <= p and q <= j)) for i in starts for j in ends if i <= j]
        good = [r for r in runs if r[1] - r[0] >= 40 and r[4] >= 0.8 * max(r[1] - r[0], r[3] - r[2])]
        found = P.align(np.array(a), np.array(b), np.array(x), np.array(y))
        assert set(found) <= set(good)
        assert max((r[1] - r[0] for r in found), default=0) == max((r[1] - r[0] for r in good), default=0)


def test_first_document_with_the_sentences_in_other_order(make_docs):
    """An early document has all seeds of a passage, but not the passage; later ones share it with each other, exactly or nearly."""
    rng = random.Random(15)
    sentences = [fresh(rng, 26) for _ in range(8)]
    whole = sum(sentences, [])
    spread = sum((whole[i : i + 20] + fresh(rng, 12) for n in range(0, len(whole) - 19, 4) for i in [(n * 37) % (len(whole) - 19)]), [])
    every = sum((whole[i : i + 24] + fresh(rng, 15) for i in sorted(range(0, len(whole) - 23, 4), key=lambda i: i * 7919 % 101)), [])
    docs = [(0, " ".join(spread)), (1, " ".join(every)), *((i, " ".join(fresh(rng, 30) + whole + fresh(rng, 30))) for i in range(2, 6))]
    line = fresh(rng, 30)
    docs += [(i, " ".join(fresh(rng, 40) + line + fresh(rng, 40))) for i in range(6, 30)]
    rows = {r.doc_id: r for r in P.shared_passages(make_docs(docs)).collect()}
    for i in range(3, 6):
        assert rows[i].n_again == len(whole)
        assert "30:238:2:30:238" in rows[i].passages.split(",")
    assert rows[2].n_shared == len(whole) and rows[2].n_again == 0
    assert all(rows[i].n_shared == 0 for i in range(6, 30))


def test_extension_of_many_pairs_is_that_of_each():
    rng = np.random.default_rng(21)
    a, b = ([rng.integers(0, 2, int(rng.integers(0, 25))) for _ in range(300)] for _ in range(2))
    b = [np.where(rng.random(len(y)) < 0.7, np.resize(x, len(y)) if len(x) else y, y) for x, y in zip(a, b)]
    lists = [pa.array([r.tolist() for r in rows], pa.list_(pa.int32())) for rows in (a, b)]
    for backwards in (False, True):
        each = [P.extend(x[::-1], y[::-1]) if backwards else P.extend(x, y) for x, y in zip(a, b)]
        assert list(zip(*(c.tolist() for c in P.extend_all(*lists, backwards)))) == each


def test_passage_that_goes_on_far_beyond_its_seeds(make_docs):
    """One word in five replaced on both sides of an equal run: there is no seed there, and the passage is longer than the first margins."""
    rng = random.Random(31)
    side, run = fresh(rng, 200), fresh(rng, 150)
    like = lambda tag: [w if k % 5 else f"{tag}{k}" for k, w in enumerate(side)]
    docs = [(i, " ".join(fresh(rng, 20) + like(f"q{i}x") + run + like(f"r{i}x") + fresh(rng, 20))) for i in (0, 1)]
    rows = {r.doc_id: r for r in P.shared_passages(make_docs(docs)).collect()}
    assert rows[1].n_links == 1 and rows[1].n_again >= 540


def test_recall_by_similarity(make_docs):
    """Pairs of 60-word passages with evenly replaced words that are found: the guarantee and the blind spot the README states."""
    rng = random.Random(5)
    found = {}
    for every in (6, 8, 10):
        docs = []
        for pair in range(60):
            passage, shift = fresh(rng, 60), rng.randrange(every)
            for i in (0, 1):
                changed = passage if i == 0 else [w if (k + shift) % every else rng.choice(fresh(rng, 1)) for k, w in enumerate(passage)]
                docs.append((2 * pair + i, " ".join(fresh(rng, 20) + changed + fresh(rng, 20))))
        rows = P.shared_passages(make_docs(docs)).collect()
        found[every] = sum(r.doc_id % 2 == 1 and r.n_links == 1 for r in rows) / 60
    print(found)
    assert found[10] >= 0.9 and found[6] <= found[8] <= found[10]


def random_chain(rng):
    """Words and margins of two documents, and matches with replaced, inserted, repeated and wide other words between them."""
    a, b, x, y = [], [], [], []
    for n in range(int(rng.integers(1, 7))):
        if n:
            kind, size = int(rng.integers(0, 5)), int(rng.integers(1, 30))
            gap = rng.integers(0, 1 << 30, size).tolist()
            other = {0: gap, 1: [w + (j == size // 2) for j, w in enumerate(gap)], 2: gap[: size // 2], 3: [], 4: gap[::-1]}[kind]
            a += gap
            b += other
            if rng.random() < 0.15:
                a += rng.integers(0, 1 << 30, int(rng.integers(40, 120))).tolist()
                b += rng.integers(0, 1 << 30, int(rng.integers(0, 120))).tolist()
        same = rng.integers(0, 1 << 30, int(rng.integers(5, 40))).tolist()
        at = sorted({0, *rng.integers(0, len(same) - 4, 3).tolist()})
        x += [len(a) + j for j in at]
        y += [len(b) + j for j in at]
        a += same
        b += same
    if rng.random() < 0.3:  # a match on another diagonal that overlaps the last one
        x.append(x[-1] + 2)
        y.append(y[-1] + 1 + int(rng.integers(0, 80)))
        tail = rng.integers(0, 1 << 30, 100).tolist()
        a, b = a + tail, b + tail
    around = [rng.integers(0, 3, int(rng.integers(0, 60))).tolist() for _ in range(2)]
    front = [[w if rng.random() < 0.8 else -1 for w in around[0]] for _ in range(2)]
    back = [[w if rng.random() < 0.8 else -1 for w in around[1]] for _ in range(2)]
    return front[0] + a + back[0], front[1] + b + back[1], [p + len(front[0]) for p in x], [p + len(front[1]) for p in y]


def test_many_chains_are_judged_like_each(monkeypatch):
    """Most chains are judged together, with the passages that each has on its own."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(400):
        a, b, x, y = random_chain(rng)
        low = rng.integers(0, 2, 2) * 7
        rows.append({"key": i, "head": -i, "x": [p + int(low[0]) for p in x], "y": [p + int(low[1]) for p in y], "low_x": int(low[0]), "low_y": int(low[1]), "more": bool(rng.random() < 0.5), "a": a, "b": b})
    expected, chains, parted = set(), 0, 0
    for r in rows:
        a, b, x, y = (np.array(r[c]) for c in ("a", "b", "x", "y"))
        x, y = x - r["low_x"], y - r["low_y"]
        front, back = P.extend(a[: x[0]][::-1], b[: y[0]][::-1]), P.extend(a[x[-1] + 5 :], b[y[-1] + 5 :])
        if (r["low_x"] and r["low_y"] and front[2]) or (r["more"] and back[2]):
            expected.add((r["key"], -r["key"], r["x"][0], r["y"][0], None, True))
            continue
        found = P.align(a, b, x, y)
        expected |= {(r["key"], -r["key"], x0 + r["low_x"], y0 + r["low_y"], (x1 + r["low_x"], y1 + r["low_y"], equal), False) for x0, x1, y0, y1, equal in found}
        whole = [(x[0] - front[0], x[-1] + 5 + back[0])] == [f[:2] for f in found]
        chains, parted = chains + whole, parted + (len(found) > 1)
    integers, numbers = pa.list_(pa.int32()), pa.int32()
    schema = pa.schema([("key", pa.int64()), ("head", pa.int64()), ("x", integers), ("y", integers), ("low_x", numbers), ("low_y", numbers), ("more", pa.bool_()), ("a", integers), ("b", integers)])
    alone = []
    monkeypatch.setattr(P, "align", lambda *args, own=P.align: alone.append(0) or own(*args))
    for part in (pa.RecordBatch.from_pylist(rows, schema), pa.RecordBatch.from_pylist(rows[:1] + rows, schema).slice(1)):
        alone.clear()
        out = P.aligned_all(part).to_pylist()
        got = [(r["key"], r["head"], r["x0"], r["y0"], None if r["left"] else (r["x1"], r["y1"], r["equal"]), r["left"]) for r in out]
        assert len(set(got)) == len(got) and set(got) == expected
        assert chains > 60 and parted > 5 and len(alone) < 400 - chains - sum(e[5] for e in expected)
    assert P.aligned_all(pa.RecordBatch.from_pylist([r | {"a": [0] * 12, "b": [0] * 12, "x": [0], "y": [0], "low_x": 0, "low_y": 0, "more": False} for r in rows[:3]], schema)) is None


def test_winnowed_places_against_brute_force():
    rng = np.random.default_rng(3)
    for window in range(1, 20):
        grams, valid = rng.integers(0, 6, 60).astype(np.uint64), rng.random(60) < 0.97
        expected = {i + max(j for j in range(window) if grams[i + j] == grams[i : i + window].min()) for i in range(61 - window) if valid[i : i + window].all()}
        assert winnow(grams, valid, window).tolist() == sorted(expected)
    assert not len(winnow(grams[:3], valid[:3], 4))
