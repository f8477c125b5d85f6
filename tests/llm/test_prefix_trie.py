import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm.prefix_trie import fattest, prefix_trie

DDL = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    original = {c: [v[3] for v in sorted(vs)] for c, vs in convs.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = original.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    nodes, kids, totals = defaultdict(list), defaultdict(set), defaultdict(lambda: [0, 0])
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    for k, members in nodes.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            totals[k[:d]][0] += not kids[k]
            totals[k[:d]][1] += (len(members) - 1) * words
    ids = lambda k, m: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k))))
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), *totals[k], hashlib.sha256(ids(k, m).encode()).hexdigest()) for k, m in nodes.items()
    )


def run(frame, **options):
    return sorted((tuple(r) for r in prefix_trie(frame, **options).collect()), key=lambda r: r[:2])


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(-25, 90):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", ""])))
    rows += [(100 + i, t, "user", "same text here") for i in range(12) for t in range(5)]  # copies
    rows += [(200, t, "user", f"turn {t}") for t in range(70)] + [(201, t, "user", f"turn {t}" if t < 41 else "other") for t in range(50)]  # long, parted late
    rows += [(301, None, "user", "z"), (301, 3, None, None), (301, 3, "user", "tie"), (301, 3, "user", "tie"), (None, 1, "user", "lost")]
    frame = spark.createDataFrame(rows, DDL)
    want = brute(rows)
    assert run(frame) == want
    assert run(frame.withColumns({n: F.lit("x") for n in ("depth", "fp", "pos", "digest", "node", "size")}), batches=(1, 2, 3)) == want


def test_few_rows(spark):
    assert run(spark.createDataFrame([], DDL)) == []
    one = [(21, 0, "user", "a b")]  # its family's first conversation is absent
    assert run(spark.createDataFrame(one, DDL)) == brute(one)


@pytest.mark.parametrize(("low", "high", "want"), [(0, 1, 1), (0, 7, 4), (4, 7, 6), (6, 7, 7), (0, 399, 256), (256, 399, 384)])
def test_fattest(spark, low, high, want):
    assert spark.sql(f"select {fattest('a', 'b')} from values (bigint({low}), bigint({high})) t(a, b)").first()[0] == want
