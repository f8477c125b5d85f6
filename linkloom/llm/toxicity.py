"""Toxicity by a classifier chain.

Categories are predicted one after another: each has a linear (logistic) model
over features of the text and the probabilities of the categories before it.  In
training those probabilities are out-of-fold predictions, so a later model sees
earlier ones as unsure as they will be on new texts.  ``labels.toxic`` is the
last category; the ones before it are the toxic rows that use a term of a seed
list.

Features are words and word beginnings (inflected forms share them), the
``FEATURES`` most associated with the label on a sample of about ``SAMPLE``
labelled rows, chosen by a hash of the id.  Counts over the sample are
aggregated by Spark; the sample's hits on the chosen features, at most
``SAMPLE`` short rows, train the models on the driver.  All rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, mod_crc32, per_batch, staged, table
from .words import ALNUM, Words, chunks, powers

SAMPLE = 10_000
FEATURES = 256
PREFIXES = (5, 6, 7)
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
#: Terms by which labelled rows are put into the earlier categories.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting"),
}
CATEGORIES = (*SEEDS, "toxic")


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and word beginning of the texts."""
    words = Words(texts, ALNUM)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, hashes = [words.text], [words.hashes()]
    sizes = words.ends - words.starts
    for k in PREFIXES:
        long = np.flatnonzero(sizes > k)
        at = words.starts[long][:, None] + np.arange(k)
        text.append(words.text[long])
        hashes.append(mix64((words.byte_hashes(at) * powers(k)).sum(axis=1, dtype=np.uint64) + np.uint64(k)))
    return np.concatenate(text), np.concatenate(hashes)


def word_hash(word: str) -> int:
    return int(Words([word.encode()]).hashes().view(np.int64)[0])


def _hits(texts: list[bytes | None], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) for features in the sorted array ``known``."""
    text, hashes = features(texts)
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    cell, count = np.unique(text[hit] * len(known) + at[hit], return_counts=True)
    return cell // len(known), cell % len(known), count


def association(examples: DataFrame, limit: int) -> list[int]:
    """Hashes of the ``limit`` features with the largest chi-square against ``label``, over (label, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            labels, texts = rows.column(0).to_numpy(), bytes_of(rows.column(1))
            for part in chunks(texts):
                text, hashes = features(texts[part])
                order = np.lexsort((text, hashes))
                text, hashes = text[order], hashes[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                text, hashes = text[new], hashes[new]
                unique, inverse = np.unique(hashes, return_inverse=True)
                positive = np.bincount(inverse, weights=labels[part][text] == 1, minlength=len(unique))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unique.view(np.int64)), pa.array(positive.astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(unique)))], ["feature", "positive", "total"]
                )

    totals = examples.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not totals[0] or totals[0] == totals[1]:
        return []
    seen = examples.select("label", "text").mapInArrow(count, "feature bigint, positive bigint, total bigint")
    sums = seen.groupBy("feature").agg(F.sum("positive").cast("double").alias("a"), F.sum("total").cast("double").alias("t")).filter("t >= 5")
    p, n = float(totals[0]), float(totals[1])
    chi = n * (F.col("a") * (n - p) - (F.col("t") - F.col("a")) * p) ** 2 / (F.col("t") * (n - F.col("t")) * p * (n - p))
    best = sums.filter(f"t < {n}").select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(limit)
    return [r.feature for r in best.collect()]


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 300) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    if not len(x):
        return np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    v = np.ones(x.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.27 * np.linalg.norm(x @ v) ** 2 + ridge)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        new = ahead - step * (x.T @ (p - y) + penalty * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def predict_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One model per column of ``y``; each sees out-of-fold predictions of the columns before it."""
    models, inputs = [], x
    for c in range(y.shape[1]):
        outside = np.zeros(len(x))
        for k in np.unique(fold):
            outside[fold == k] = predict_linear(fit_linear(inputs[fold != k], y[fold != k, c]), inputs[fold == k])
        models.append(fit_linear(inputs, y[:, c]))
        inputs = np.concatenate([inputs, outside[:, None]], axis=1)
    return models


def predict_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = []
    for w in models:
        out.append(predict_linear(w, x))
        x = np.concatenate([x, out[-1][:, None]], axis=1)
    return np.stack(out, axis=1)


def _matrix(hits: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, width: int) -> np.ndarray:
    x = np.zeros((rows, width))
    x[hits[0], hits[1]] = np.log2(1.0 + hits[2])
    return x


def train(docs: DataFrame, labels: DataFrame, test_fold: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted feature hashes, and the models of the chain."""
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = staged(known.filter("label in (0, 1)").filter(mod_crc32("label_id", FOLDS) != test_fold), "labels")
    rate = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < rate * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = staged(rows.join(chosen, rows.doc_id == chosen.label_id).select("doc_id", "label", "text"), "examples")
    seeds = {c: [word_hash(t) for t in terms] for c, terms in SEEDS.items()}
    picked = {*association(examples, FEATURES), *(h for own in seeds.values() for h in own)}
    known_hashes = np.sort(np.array(list(picked), np.int64).view(np.uint64))

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_of(batch.column(2))
        lists: list[list[int]] = [[] for _ in texts]
        for part in chunks(texts):
            for t, f, n in zip(*_hits(texts[part], known_hashes), strict=True):
                lists[part.start + t] += [int(f), int(n)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "label", "hits"])

    found = per_batch(examples, hits, "doc_id bigint, label int, hits array<int>").withColumn("fold", mod_crc32("doc_id", FOLDS)).orderBy("doc_id").collect()
    x = np.zeros((len(found), len(known_hashes)))
    for i, r in enumerate(found):
        x[i, r.hits[::2]] = np.log2(1.0 + np.array(r.hits[1::2], float))
    toxic = np.array([r.label for r in found], float)
    columns = [np.searchsorted(known_hashes, np.array(own, np.int64).view(np.uint64)) for own in seeds.values()]
    y = np.stack([toxic * (x[:, c].sum(axis=1) > 0) for c in columns] + [toxic], axis=1) if len(found) else np.zeros((0, len(CATEGORIES)))
    return known_hashes, fit_chain(x, y, np.array([r.fold for r in found], np.int64))


def categorised(docs: DataFrame, labels: DataFrame, test_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, p_<category>..., toxic) per row of ``docs``.

    Labels of rows whose crc32(doc_id) mod ``FOLDS`` is ``test_fold`` are not
    learned from; NULL labels are ignored, an id labelled twice takes the larger
    one.  Texts without a known feature, NULL and empty ones among them, get the
    base rates and are not toxic.  Without labels every probability is one half
    and nothing is toxic.
    """
    hashes, models = train(docs, labels, test_fold)
    blank = not any(np.abs(m).sum() for m in models)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts, out, some = bytes_of(rows.column(1)), [], []
        for part in chunks(texts):
            x = _matrix(_hits(texts[part], hashes), len(texts[part]), len(hashes))
            out.append(predict_chain(models, x))
            some.append(x.any(axis=1))
        p = np.concatenate(out)
        toxic = (p[:, -1] >= THRESHOLD) & np.concatenate(some) & (not blank)
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(toxic)], ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = per_batch(slim, batch, "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")
    return out.withColumn("held_out", mod_crc32("doc_id", FOLDS) == test_fold)


def op6_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    return categorised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
