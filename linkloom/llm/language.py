"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
found by a forward pass; that of a text is the product over its words.  Piece
probabilities are learned by expectation-maximisation (forward-backward) from
the word counts of a sample of labelled texts, of about ``SAMPLE`` rows a
language, chosen by a hash of the id.

Different words are scored once per batch and remembered by a worker; texts are
cut into words and summed in flat arrays.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mod_crc32, partitions_of, per_batch, staged, table
from .lattice import PieceTable, forward
from .words import Words, chunks

#: Expected number of sampled rows per language.
SAMPLE = 800
ROUNDS = 3
PSEUDO = 0.05
#: Probability of a character that is in no piece.
UNKNOWN = 1e-7
UNDETERMINED = "und"
CACHE = 1_000_000

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a SentencePiece model by text (their space mark kept), numbered from 0; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: k for k, p in enumerate(p for p in pieces if p == p.lower() and "▁" not in p[1:])}


def arcs(word: str, pieces: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in ``word``, ordered by end; piece -1 is a character without one."""
    out = []
    for end in range(1, len(word) + 1):
        single = True
        for start in range(max(0, end - longest), end):
            k = pieces.get(word[start:end])
            if k is not None:
                out.append((start, end, k))
                single &= start < end - 1
        if single:
            out.append((end - 1, end, -1))
    return out


class Scorer:
    """Log-probabilities of words in every language, with a cache."""

    def __init__(self, probabilities: np.ndarray, pieces: dict[str, int]) -> None:
        self.log = np.log(probabilities)
        self.table = PieceTable([p.encode() for p in pieces], list(pieces.values()))
        self.languages = len(probabilities)
        self.known: dict[int, int] = {}
        self.scores = np.zeros((0, self.languages))

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages) log-sums over all segmentations, by one forward pass over all words."""
        marked = [("▁" + w.lower()).encode() for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        raw = np.frombuffer(b"".join(marked), np.uint8)
        start, end, ids, alone = self.table.arcs(raw, lengths)
        unknown = np.where((raw[alone] < 128) | (raw[alone] >= 192), math.log(UNKNOWN), 0.0)
        weight = np.concatenate([self.log[:, ids], np.broadcast_to(unknown, (self.languages, len(alone)))], axis=1)
        _, _, total = forward(np.append(start, alone), np.append(end, alone + 1), weight, lengths)
        return total[:, np.cumsum(lengths)].T

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text in each language, and its number of words."""
        words = Words(texts, LETTERS)
        unique, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known, self.scores = {}, self.scores[:0]
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            fresh = self.words([words.word(first[i]) for i in new])
            self.known.update(zip((keys[i] for i in new), range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, fresh])
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        each = self.scores[place][inverse]
        sums = np.stack([np.bincount(words.text, weights=each[:, k], minlength=len(texts)) for k in range(self.languages)], axis=1) if len(words) else np.zeros((len(texts), self.languages))
        return sums, words.counts


def sampled_words(learn: DataFrame, sample: int) -> DataFrame:
    """(lang, word, n) of about ``sample`` rows of each language."""
    sizes = learn.groupBy("lang").agg(F.count("*").alias("size")).collect()
    if not sizes:
        return learn.select("lang", F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n")).limit(0)
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["size"]))).otherwise(rate)
    chosen = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, texts = rows.column(0).to_pylist(), bytes_of(rows.column(1))
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for part in chunks(own):
                    words = Words(own[part], LETTERS)
                    _, first, counts = np.unique(words.hashes(), return_index=True, return_counts=True)
                    if len(first):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(first)), pa.array([words.word(i).lower() for i in first]), pa.array(counts, pa.int64())], ["lang", "word", "n"]
                        )

    return chosen.select("lang", "text").mapInArrow(split, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn_pieces(words: DataFrame, languages: list[str], pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """(languages, pieces) probabilities by ``rounds`` of expectation-maximisation over the word counts."""
    p = np.full((len(languages), len(pieces)), 1 / len(pieces))
    longest = max(map(len, pieces))
    index = {lang: k for k, lang in enumerate(languages)}

    def expect(current: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(current)
            rows_of = current.tolist()
            for rows in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if len(word) > 64:  # no word of a language
                        continue
                    k, marked = index[lang], "▁" + word
                    prob = rows_of[k]
                    found = [(s, e, i, prob[i] if i >= 0 else UNKNOWN) for s, e, i in arcs(marked, pieces, longest)]
                    alpha, beta = [1.0] + [0.0] * len(marked), [0.0] * len(marked) + [1.0]
                    for s, e, _, q in found:
                        alpha[e] += alpha[s] * q
                    for s, e, _, q in reversed(found):
                        beta[s] += beta[e] * q
                    if alpha[-1] > 0:
                        for s, e, i, q in found:
                            if i >= 0:
                                sums[k, i] += n * alpha[s] * q * beta[e] / alpha[-1]
            k, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(sums[k, i])], ["k", "i", "n"])

        return run

    for _ in range(rounds):
        totals = words.mapInArrow(expect(p), "k int, i int, n double").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
        p = np.full_like(p, PSEUDO)
        for r in totals:
            p[r.k, r.i] += r.n
        p /= p.sum(axis=1, keepdims=True)
    return p


_scorers: dict[str, Scorer] = {}


def identified(docs: DataFrame, model: str, folds: int = 4, test_fold: int = 2, sample: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``; score is the share of the predicted language in the posterior.

    Learned from rows with a language whose crc32(doc_id) mod ``folds`` is not
    ``test_fold``.  A NULL text, and one without a letter, is ``und`` with score
    0; so is every text if no row has a language.  Equal scores go to the first
    language in the order of names.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = rows.filter("lang is not null and text is not null").filter(mod_crc32("doc_id", folds) != test_fold)
    words = staged(sampled_words(learn, sample), "words").repartition(partitions_of(docs))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = vocabulary(model)
    probabilities = learn_pieces(words, languages, pieces) if languages else np.zeros((0, len(pieces)))
    token = uuid.uuid4().hex

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        if token not in _scorers:
            _scorers.clear()
            _scorers[token] = Scorer(probabilities, pieces)
        scorer, texts = _scorers[token], bytes_of(rows.column(1))
        pred, score = [], []
        for part in chunks(texts):
            if not languages:
                pred += [UNDETERMINED] * len(texts[part])
                score += [0.0] * len(texts[part])
                continue
            sums, counts = scorer.texts(texts[part])
            best = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            for t, n, k, s in zip(texts[part], counts, best, share, strict=True):
                known = n and (t.isascii() or any(c.isalpha() for c in t.decode("utf-8", "replace")))
                pred.append(languages[k] if known else UNDETERMINED)
                score.append(float(s) if known else 0.0)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = per_batch(rows.select("doc_id", "text"), batch, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", (mod_crc32("doc_id", folds) == test_fold).alias("held_out"), "lang_pred", "score")


def op4_marginal_unigram_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identified(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
