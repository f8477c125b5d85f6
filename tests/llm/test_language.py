import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linkloom.llm import language as L
from linkloom.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_pass_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "▁aba"])}
    rng = np.random.default_rng(4)
    p = rng.random((3, len(pieces)))
    scorer = L.Scorer(p, pieces)
    for word in ("a", "ab", "abab", "abca", "zz"):
        marked = "▁" + word
        total = np.zeros(3)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
            parts = [marked[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            known = [p[:, pieces[x]] if x in pieces else np.full(3, L.UNKNOWN) if len(x) == 1 else np.zeros(3) for x in parts]
            total += np.prod(known, axis=0)
        assert np.allclose(scorer.words([word, "b"])[0], np.log(total))


def test_long_words_do_not_vanish():
    pieces = L.vocabulary(PATH)
    p = np.full((2, len(pieces)), 1 / len(pieces))
    value = L.Scorer(p, pieces).words(["xyzzy" * 4000])[0]
    assert all(math.isfinite(v) for v in value)


def test_held_out_accuracy(spark, small):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op4_marginal_unigram_language"](spark, small).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("known", [True, False])
def test_odd_rows(make_docs, odd_texts, known):
    docs = make_docs(odd_texts + [(20, "123 — 456 !"), (21, "das ist ein satz und noch ein satz")], lang="de").withColumn("n", F.lit("x"))
    if not known:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    rows = L.identified(docs, PATH).collect()
    assert len(rows) == len(odd_texts) + 2
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 20))
    assert by_id[21].lang_pred == ("de" if known else "und")
    assert L.identified(make_docs([]), PATH).collect() == []
