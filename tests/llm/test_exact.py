import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm.exact import directory, exact_groups, heavy_keys

WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    bodies = [(t or "").translate(WHITE) for _, t in rows]
    groups = {}
    for n, body in enumerate(bodies):
        groups.setdefault(body, []).append(n)
    order = lambda n: (-len(rows[n][1] or ""), rows[n][0] is None, rows[n][0] or 0, n)
    out = []
    for body, members in groups.items():
        best = min(members, key=order)
        out += [(rows[n][0], rows[best][0], len(members), n == best, hashlib.sha256(body.encode()).hexdigest()) for n in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("capacity", "key_bits"), [(256, 64), (2, 64), (2, 3), (1, 0)])
def test_against_brute_force(make_docs, odd_texts, capacity, key_bits):
    rows = odd_texts + [(20 + i, f"copy  {'' if i % 3 else ' '}of\tone text") for i in range(90)] + [(200 + i, f"text {i % 17}") for i in range(60)] + [(None, "text 3"), (None, None), (-4, "\r\n")]
    got = exact_groups(make_docs(rows), capacity=capacity, key_bits=key_bits).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert exact_groups(make_docs([])).count() == 0
    docs = make_docs([(1, "a b"), (2, "ab")])
    for name in ("key", "body", "page", "slot", "bucket", "row_id", "n", "best", "sha256", "keep_id"):
        docs = docs.withColumn(name, F.lit("x"))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()} == {(1, 1, 2, True), (2, 1, 2, False)}


def test_directory_splits_overfull_buckets_only(spark):
    # 40 keys below one 12-bit prefix, one key with many rows, few keys elsewhere
    keys = [((5 << 52) + (i << 44), 2) for i in range(40)] + [(-7, 1000), (1 << 61, 2), (3 << 61, 2), (-8, 1)]
    frame = spark.createDataFrame(keys, "key long, n long")
    slots, depth = directory(frame, 10)
    table = {r.slot: (r.bucket, r.pages) for r in slots.collect()}
    loads, owners = {}, {}
    for key, n in keys:
        bucket, pages = table[(key & (1 << 64) - 1) >> (64 - depth)]
        loads[bucket] = loads.get(bucket, 0) + (0 if 4 * n > 10 else n)
        owners.setdefault(bucket, set()).add(key)
        assert pages == 1
    assert {tuple(r) for r in heavy_keys(frame, 10).collect()} == {(k, -(-n // 10)) for k, n in keys if 4 * n > 10}
    assert all(n <= 10 or len(owners[b]) == 1 for b, n in loads.items())
    assert depth > 12 and len({b for b, _ in table.values()}) < 60
    # a slot's bucket is a prefix of the slot, so buckets own ranges of keys
    for slot, (bucket, _) in table.items():
        own = bucket.bit_length() - 1
        assert bucket == (1 << own) + (slot >> (depth - own))


def test_directory_stops_at_its_bound(spark):
    keys = spark.createDataFrame([(i, 1) for i in range(50)], "key long, n long")
    slots, depth = directory(keys, 4, max_depth=6)
    assert [(r.slot, r.bucket, r.pages) for r in slots.collect()] == [(0, 1 << 6, 13)] and depth == 6
    assert directory(keys.limit(0), 4)[0].count() == 0
