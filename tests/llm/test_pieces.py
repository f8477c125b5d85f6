from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from linkloom.llm import pieces as M

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_lossless_and_decodable_by_the_library(make_docs, odd_texts):
    extra = ["  two  blanks \n\n lines\n", "▁mark ▁▁", "漢字 😀\t\x00", " ", "\n", "x " * 300, "ab" * 500]
    docs = odd_texts + list(enumerate(extra, 100))
    frame = make_docs(docs).withColumn("ids", F.lit("clash")).withColumn("lossless", F.lit(0))
    encoded = M.sampled_pieces(frame, PATH)
    rows = encoded.collect()
    assert len(rows) == len(docs) and all(r.lossless for r in rows)
    tool = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sorted(tool.decode(r.ids) for r in rows) == sorted(t or "" for _, t in docs)
    assert sorted(r.text for r in M.decoded(encoded, PATH).collect()) == sorted(t or "" for _, t in docs)
    assert M.sampled_pieces(make_docs([]), PATH).collect() == []


def test_same_key_same_pieces(make_docs, small_docs):
    one = {r.doc_id: r.ids for r in M.sampled_pieces(small_docs, PATH).collect()}
    two = {r.doc_id: r.ids for r in M.sampled_pieces(small_docs.repartition(7), PATH).collect()}
    other = {r.doc_id: r.ids for r in M.sampled_pieces(small_docs, PATH, seed=5).collect()}
    assert one == two and one != other


def segmentations(word, weight):
    if not word:
        return [((), 1.0)]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in weight:
            out += [((word[:n], *rest), weight[word[:n]] * p) for rest, p in segmentations(word[n:], weight)]
    return out


def test_draws_follow_the_lattice():
    store = M.Lattices(M.Pieces(PATH))
    weight = {p: float(np.exp(store.pieces.log_weight[i])) for i, p in enumerate(store.pieces.bytes) if p and i not in set(store.pieces.byte.tolist())}
    all_ways = dict(segmentations(b" hello", weight))
    total, n = sum(all_ways.values()), 40_000
    ids, counts = M.encode([b"hello"] * n, np.arange(n), store)
    ends = np.cumsum(counts)
    seen = Counter(tuple(store.pieces.bytes[i] for i in ids[e - c : e]) for c, e in zip(counts, ends, strict=True))
    assert set(seen) <= set(all_ways)
    expected = {k: n * p / total for k, p in all_ways.items() if n * p / total >= 5}
    chi = sum((seen[k] - e) ** 2 / e for k, e in expected.items())
    assert chi < len(expected) + 5 * (2 * len(expected)) ** 0.5
