import random
import re

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in text.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def check(rows, docs):
    texts = sorted(((str(i), ",".join(base(t))) for i, t in docs))
    assert sorted((str(r.doc_id), r.base_spans) for r in rows) == texts
    for r in rows:
        have = [s for s in r.spans.split(",") if s]
        assert set(filter(None, r.base_spans.split(","))) <= set(have)
        order = sorted(have, key=lambda s: (list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])))
        assert have == order
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in r.base_spans.split(",")) for k in PATTERNS]


def test_base_spans_of_random_texts(make_docs, odd_texts):
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "x@y.zz", "é", "😀", " ", "-", ".", "1", "22", "300", "4111111111111111", "+4", "(", ")", "1.2.3.4", "_", "\n", "+1 (555) 010-9999", "%"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(400)] + odd_texts
    clash = make_docs(docs).withColumn("kind", F.lit("k")).withColumn("found", F.lit(1)).withColumn("start", F.lit("s"))
    check(P.personal_data(clash).collect(), docs)


def test_swallowed_neighbours_are_added(make_docs):
    card, other = "4111111111111111", "5500005555555559"
    docs = [(i, f"word{i} mail a{i}@host{i}.com and 10.1.2.{i} then +1 (212) 555-01{i:02d} or {card} end") for i in range(60)]
    docs += [(100, f"see {card} {other} now"), (101, "call +1 (212) 555-0147 10.20.30.40 x"), (102, "number 4111111111111112 is none")]
    rows = {r.doc_id: r for r in P.personal_data(make_docs(docs)).collect()}
    check(rows.values(), docs)
    assert rows[100].spans == "card:4:20,card:21:37" and "phone:5:22" in rows[101].spans and rows[102].spans == ""


def test_redaction(make_docs, odd_texts):
    docs = odd_texts + [(50, "é me@a.b.com, +1 (212) 555-0147!"), (51, "no data"), (51, "no data"), (52, "1.2.3.4")]
    frame = make_docs(docs).withColumn("cuts", F.lit(1)).withColumn("row_id", F.lit("r"))
    out = P.redact(frame)
    assert out.columns == frame.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    want = {50: "é [EMAIL], [PHONE]!", 52: "[IP]"}
    assert got == sorted((str(i), str(want.get(i, t))) for i, t in docs)


def test_empty(make_docs):
    assert P.personal_data(make_docs([])).collect() == [] and P.redact(make_docs([])).collect() == []


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.52]
    votes = np.stack([np.where(rng.random(4000) < r, np.where(truth, 1, -1), np.where(truth, -1, 1)) for r in right], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    odds, ratio = P.reliabilities([(0, tuple(p), c) for p, c in zip(patterns.tolist(), n.tolist(), strict=True)])[0]
    strength = ratio[:, 2] - ratio[:, 0]
    assert strength[0] > strength[2] > strength[4] > strength[5]
    z = odds + ratio[np.arange(6), votes + 1].sum(axis=1)
    assert ((z > 0) == truth).mean() > 0.95


def test_long_hosts_numbers_and_names(make_docs):
    """A million labels, digits or letters neither stop Spark nor take quadratic time."""
    n = 1_000_000
    rows = [(1, "a@b" + ".c" * n), (2, "7" * n), (3, "1." * 40_000), (4, "x" * n + "@h.de"), (5, "+1" + "-2" * n), (6, "4 " * n), (7, "a@" * n), (8, ("m@h.c" + ".d" * 50 + " ") * 2000)]
    got = {r.doc_id: r for r in P.personal_data(make_docs(rows)).collect()}
    assert got[1].base_spans == f"email:0:{3 + 2 * n}" and got[4].base_spans == f"email:0:{n + 5}"
    assert [got[i].n_email for i in range(1, 9)] == [1, 0, 0, 1, 0, 0, 0, 2000]
    assert got[3].n_ip == 10_000 and all(got[i].n_card == got[i].n_phone == 0 for i in (1, 2, 5, 6))
    assert P.redact(make_docs(rows[:1])).first().text == "[EMAIL]"
