"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each class is a normal density over the statistics.  Its covariance is shrunk
towards the pooled one (``TO_POOLED``) and that towards its diagonal
(``TO_DIAGONAL``), so statistics that never vary in one class keep a finite
scale.  The Cholesky factors are computed once; a score is the logistic function
of the difference of the two log-densities (half squared Mahalanobis distances
and log-determinants) plus the log-odds of the classes.

The statistics of all rows are written once; class counts, means and covariances
are sums, so training is one aggregation whatever the number of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mod_crc32, per_batch, staged, table
from .words import Words, chunks

TO_POOLED = 0.3
TO_DIAGONAL = 0.1
#: Variance below which no statistic is taken to be known.
FLOOR = 1e-3
THRESHOLD = 0.3

_SPACE = np.ones(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = False
_LINE = np.ones(256, bool)
_LINE[10] = False
_CLASS = np.zeros((4, 256), bool)
_CLASS[0, list(b"#*$%&|<>")] = True
_CLASS[1, list(b"!?")] = True
_CLASS[2, 48:58] = True
_CLASS[3, list(b".,;:")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = _LETTER[128:] = True


def _distinct(words: Words, keep: np.ndarray | None = None) -> np.ndarray:
    """Number of different words of each text."""
    n = len(words.counts)
    text, hashes = words.text, words.hashes()
    if keep is not None:
        text, hashes = text[keep], hashes[keep]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(text[new], minlength=n)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """(n, 9) transformed statistics; texts without words have zeros in all shares."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols, shouts, digits, stops = (np.add.reduceat(c[raw], starts, dtype=np.int64) for c in _CLASS)
    inner = _UPPER[raw]
    inner[1:] &= _LETTER[raw[:-1]]  # capitals that open a word are no sign of shouting
    upper = np.add.reduceat(inner, starts, dtype=np.int64)
    words, lines = Words(texts, _SPACE), Words(texts, _LINE)
    n = words.counts
    letters = np.bincount(words.text, weights=words.ends - words.starts, minlength=len(texts))
    holds = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    full = np.bincount(lines.text[holds], minlength=len(texts))
    each = lambda x, of: x / np.maximum(of, 1)
    share = lambda x, of, scale, prior=10: np.log1p(scale * x / (of + prior))  # noqa: E731  a few words show little
    return np.stack(
        [
            np.log1p(n), np.log1p(each(letters, n)), share(symbols, n, 20), share(upper, letters, 20), share(shouts, n, 20),
            share(digits, letters, 20), share(stops, n, 5), np.log1p(n) * (1 - each(_distinct(words), n)), share(full - _distinct(lines, holds), full, 10, 3),
        ], axis=1,
    ).astype(np.float64)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) per row of ``docs``."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = bytes_of(rows.column(1))
        x = np.concatenate([statistics(texts[part]) for part in chunks(texts)])
        flat = pa.array(x.ravel())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)], ["doc_id", "x"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return per_batch(slim, batch, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log-odds of classes 1 and 0; without one of the classes, a constant score."""

    mean: np.ndarray | None
    factor: np.ndarray | None
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.factor is not None:
            for sign, mean, factor in zip((1, -1), self.mean, self.factor, strict=True):
                half = np.linalg.solve(factor, (x - mean).T)
                z -= sign * (0.5 * (half**2).sum(axis=0) + np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _matrix(rows: pa.RecordBatch, name: str) -> np.ndarray:
    x = rows.column(name)
    return x.flatten().to_numpy().reshape(len(x), -1)


def fit(examples: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """Train on (label, x) rows; labels other than 0 and 1 are ignored."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            labels, x = rows.column("label").to_numpy(), _matrix(rows, "x")
            for c in (0, 1):
                own = np.concatenate([np.ones((int((labels == c).sum()), 1)), x[labels == c]], axis=1)
                sums[c] = sums.get(c, 0) + own.T @ own
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, c), pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], ["label", "cell", "total"])

    clean = examples.filter("label in (0, 1) and x is not null").select(F.col("label").cast("int").alias("label"), "x")
    rows = clean.mapInArrow(partial, "label int, cell int, total double").groupBy("label", "cell").agg(F.sum("total").alias("total")).collect()
    width = int(round(max((r.cell for r in rows), default=0) + 1) ** 0.5)
    sums = np.zeros((2, width * width))
    for r in rows:
        sums[r.label, r.cell] = r.total
    sums = sums.reshape(2, width, width)
    n = sums[:, 0, 0]
    if width < 2 or n.min() < 2:
        return Discriminant(None, None, float(np.log((n[1] + 1) / (n[0] + 1)) + (1 if n[1] >= n[0] else -1)))
    mean = sums[:, 0, 1:] / n[:, None]
    scatter = np.stack([s[1:, 1:] - k * np.outer(m, m) for s, k, m in zip(sums, n, mean, strict=True)])
    pooled = scatter.sum(axis=0) / n.sum()
    factors = []
    for s, k in zip(scatter, n, strict=True):
        cov = (1 - to_pooled) * s / k + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov))
        factors.append(np.linalg.cholesky(cov + FLOOR * np.eye(len(cov))))
    return Discriminant(mean[::-1], np.stack(factors[::-1]), float(np.log(n[1] / n[0])))


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, test_fold: int = 0, id_col: str = "doc_id") -> tuple[DataFrame, Discriminant]:
    """The written statistics of all rows, and the model learned from the labelled ones outside ``test_fold``."""
    seen = staged(document_statistics(docs, id_col), "statistics")
    known = labels.groupBy(F.col(id_col).cast("bigint").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    learn = seen.filter(mod_crc32("doc_id", folds) != test_fold)
    return seen, fit(learn.join(known, learn.doc_id == known.label_id).select("label", "x"))


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, test_fold: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score) per row of ``docs``.

    Labels are learned from rows whose crc32(doc_id) mod ``folds`` is not
    ``test_fold``.  NULL and empty texts are scored like others; NULL labels are
    ignored; an id labelled twice takes the larger label.  With less than two
    rows of a class every score is the same.  An empty table gives no rows.
    """
    seen, model = trained(docs, labels, label_col, folds, test_fold, id_col)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(_matrix(rows, "x")))], ["doc_id", "score"])

    out = per_batch(seen, batch, "doc_id bigint, score double")
    return out.select("doc_id", (mod_crc32("doc_id", folds) == test_fold).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, with or without an id.

    Rows are scored where they are read, by the finished model; texts are not
    shuffled.
    """
    _, model = trained(docs, labels)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = bytes_of(column)
        return pa.array(np.concatenate([model.score(statistics(texts[part])) for part in chunks(texts)]) if texts else np.zeros(0))

    return docs.filter(score(docs["text"].cast("string")) >= threshold)


def op2_quality_discriminant(spark, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
