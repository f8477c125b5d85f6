"""Personal data by weak supervision, with DataFrame operations only.

Patterns propose spans.  Labelers vote on each (1 yes, -1 no, 0 abstains):
checks of the digits and the shape, gazetteers, and the context on both sides.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of labelers per kind, whatever the size of the corpus) estimates how
reliable each labeler is for each kind.  Its posteriors are the soft labels of
the final classifier, a logistic regression over features of the span, trained
on counts of feature patterns (at most 2 to the number of features per kind).

A span of the base patterns stays in any case; the classifier decides on the
others, which is where a greedy base match has swallowed its neighbour and
failed.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pin import let, pinned
from .common import fresh, staged, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns.  A look-behind (or the end of the last match) and possessive repeats keep long runs linear and match the same spans.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further patterns, stricter in form.
MORE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{{2,}}",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Fixed values of the gazetteers: first digits of card issuers, country calling codes, endings of host names, words of the context.
CARD_ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|62)"
CALLING_CODES = "^[+](1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
HOST_ENDINGS = "[.](com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$"
WORDS_BEFORE = "(?i)(mail|contact|call|phone|tel|fax|mobile|card|visa|credit|debit|payment|host|server|address|login|from)[^A-Za-z]{0,12}$"
WORDS_AGAINST = "(?i)(version|release|section|chapter|token|key|hash|isbn|order|ticket|invoice)[^A-Za-z]{0,12}$|[vV=\"]$"
LABELERS = ("valid", "shape", "gazetteer", "before", "against", "apart")
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "valid", "shape", "plus", "joined", "left_open", "right_open")
EM_ROUNDS = 50
ACCEPT = 0.5
CONTEXT = 24


def _found(text: Column, pattern: str, hint: str) -> Column:
    """Matches in order, each with the length of the text before it (since the last match) and its context."""

    def cut(matches: Column) -> Column:
        def pair(gaps: Column) -> Column:
            return F.transform(
                matches,
                lambda m, i: F.struct(
                    m.alias("m"), F.length(F.get(gaps, i)).alias("gap"),
                    F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("pre"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("post"),
                ),
            )

        return let(F.split(text, pattern, -1), pair)

    empty = F.array().cast("array<struct<m:string,gap:int,pre:string,post:string>>")
    return F.when(text.rlike(hint), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, cut(m)).otherwise(empty))).otherwise(empty)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _matches(text_col: str) -> Column:
    """The matches of each kind and pattern set in a text; NULL where nothing can match."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hints = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    more = {"email": r"[\[(]at[\])]", "card": "[0-9]{4}", "phone": r"\+[0-9]"}
    sets = [(k, True, BASE[k], hints[k]) for k in KINDS] + [(k, False, MORE[k], more[k]) for k in MORE]
    found = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(b).alias("base"), _found(text, p, h).alias("at")) for k, b, p, h in sets])
    return F.when(text.rlike(r"[0-9@]|[\[(]at[\])]"), F.filter(found, lambda s: F.size(s["at"]) > 0))


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, found) per row."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _matches(text_col).alias("found"))
    return slim.select(F.monotonically_increasing_id().alias("row_id"), "*")


def candidates(marked: DataFrame) -> DataFrame:
    """(row_id, kind, base, start, end, surface, pre, post, valid): one row per proposed span."""
    rows = marked.select("row_id", F.inline("found")).select("row_id", "kind", "base", F.posexplode("at").alias("i", "s")).select("row_id", "kind", "base", "i", "s.*")
    before = "coalesce(sum(gap + length(m)) over (partition by row_id, kind, base order by i rows between unbounded preceding and 1 preceding), 0)"
    digits = F.regexp_replace("m", "[^0-9]", "")
    octets = r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"
    valid = (
        F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, F.col("m").rlike(octets))
        .when(F.col("kind") == 2, F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(8, 15))
    )
    placed = rows.withColumn("start", (F.expr(before) + F.col("gap")).cast("int")).withColumn("end", F.col("start") + F.length("m"))
    return placed.select("row_id", "kind", "base", "start", "end", F.col("m").alias("surface"), "pre", "post", valid.alias("valid"))


def _yes(test: Column, no: int = -1) -> Column:
    return F.when(test, 1).otherwise(no)


def voted(spans: DataFrame) -> DataFrame:
    """``spans`` with a column per labeler and per feature."""
    s, k = F.col("surface"), F.col("kind")
    by_kind = lambda *tests: F.element_at(F.array(*tests), k + 1)
    shape = by_kind(
        s.rlike(r"^[A-Za-z0-9].*[.\])]\x20?[A-Za-z]{2,}$") & ~s.contains(".."), s.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){3}$"),
        s.rlike(r"^([0-9]{16,19}|[0-9]{4}([\x20-])[0-9]{4}\2[0-9]{4}\2[0-9]{4})$"), s.rlike("^" + MORE["phone"].replace("(?<![0-9A-Za-z+])", "").replace("(?![0-9])", "") + "$"),
    )
    known = by_kind(s.rlike(HOST_ENDINGS), ~s.rlike("^(0|127|2[2-5][0-9])[.]"), s.rlike(CARD_ISSUERS), s.rlike(CALLING_CODES))
    left, right = F.coalesce(F.col("pre").rlike(r"[\p{L}0-9]$"), F.lit(False)), F.coalesce(F.col("post").rlike(r"^[\p{L}0-9]"), F.lit(False))
    votes = {
        "valid": _yes(F.col("valid")), "shape": _yes(shape), "gazetteer": _yes(known, 0), "before": _yes(F.col("pre").rlike(WORDS_BEFORE), 0),
        "against": F.when(F.col("pre").rlike(WORDS_AGAINST), -1).otherwise(0), "apart": F.when(left | right, -1).otherwise(1),
    }
    bits = {
        "is_email": k == 0, "is_ip": k == 1, "is_card": k == 2, "is_phone": k == 3, "valid": F.col("valid"), "shape": shape,
        "plus": s.startswith("+"), "joined": s.rlike(r"[0-9][\x20-][0-9]"), "left_open": left, "right_open": right,
    }
    return spans.select("*", *[v.cast("int").alias(f"v_{n}") for n, v in votes.items()], *[b.cast("int").alias(f"f_{n}") for n, b in bits.items()])


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict[int, tuple[float, np.ndarray]]:
    """Per kind, the log-odds and per labeler and vote (-1, 0, 1) the log-likelihood ratio, by expectation-maximisation.

    Starts from the share of yes votes.  One pseudo-count for each vote, three
    for the expected one, keeps rare kinds and labelers that always agree finite.
    """
    out = {}
    expected = np.array([[1.0, 1.0, 3.0], [3.0, 1.0, 1.0]])
    for kind in sorted({p[0] for p in patterns}):
        votes = np.array([p[1] for p in patterns if p[0] == kind])
        n = np.array([p[2] for p in patterns if p[0] == kind], float)
        yes, no = (votes == 1).sum(axis=1), (votes == -1).sum(axis=1)
        posterior = (yes + 0.5) / (yes + no + 1)
        for _ in range(rounds):
            table_ = np.zeros((2, votes.shape[1], 3))
            for y, weight in enumerate((n * posterior, n * (1 - posterior))):
                for v in range(3):
                    table_[y, :, v] = ((votes == v - 1) * weight[:, None]).sum(axis=0) + expected[y, v]
                table_[y] /= table_[y].sum(axis=1, keepdims=True)
            ratio = np.log(table_[0]) - np.log(table_[1])
            odds = math.log(((n * posterior).sum() + 1) / ((n * (1 - posterior)).sum() + 1))
            z = odds + ratio[np.arange(votes.shape[1]), votes + 1].sum(axis=1)
            posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out[kind] = (odds, ratio)
    return out


def _posterior(model: dict[int, tuple[float, np.ndarray]]) -> Column:
    z = F.lit(0.0)
    for kind, (odds, ratio) in model.items():
        own = F.lit(odds)
        for name, weights in zip(LABELERS, ratio, strict=True):
            own += F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col(f"v_{name}") + 2)
        z = F.when(F.col("kind") == kind, own).otherwise(z)
    return 1 / (1 + F.exp(-z))


def logistic(x: np.ndarray, positive: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression on counted rows, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - n * p) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def classified(spans: DataFrame) -> DataFrame:
    """``spans`` with the final classifier's ``score``, trained on these spans."""
    ready = staged(voted(spans), "votes")
    names = [f"v_{n}" for n in LABELERS]
    patterns = [(r["kind"], tuple(r[n] for n in names), r["count"]) for r in ready.groupBy("kind", *names).count().orderBy("kind", *names).collect()]
    model = reliabilities(patterns)
    bits = [f"f_{n}" for n in FEATURES]
    soft = ready.withColumn("p", F.round(_posterior(model), 9).cast("decimal(20,9)"))
    rows = soft.groupBy(*bits).agg(F.sum("p").cast("double").alias("p"), F.count("*").alias("n")).orderBy(*bits).collect()
    if not rows:
        return ready.withColumn("score", F.lit(0.0))
    w = logistic(np.array([[r[b] for b in bits] for r in rows]), np.array([r["p"] for r in rows]), np.array([float(r["n"]) for r in rows]))
    z = F.lit(float(w[-1]))
    for b, weight in zip(bits, w[:-1], strict=True):
        z += F.col(b) * F.lit(float(weight))
    return ready.withColumn("score", 1 / (1 + F.exp(-z)))


def detected(marked: DataFrame) -> DataFrame:
    """(row_id, kind, base, start, end): the spans that hold, of ``proposals`` rows.

    Base spans are the base matches that pass their check.  Another span is added
    if it passes the check of its kind, the classifier accepts it, no base span
    overlaps it, and no proposal that starts before it (or, at the same start,
    scores higher) does.
    """
    scored = staged(classified(candidates(marked)), "scored")
    base = scored.filter("base and valid").select("row_id", "kind", "base", "start", "end")
    added = scored.filter(F.col("score") >= ACCEPT).filter("valid and not base").select("row_id", "kind", F.lit(False).alias("base"), "start", "end", "score")
    both = base.withColumn("score", F.lit(2.0)).unionByName(added)
    reach = "max(if({0}, end, 0)) over (partition by row_id order by start, score desc, end desc, kind rows between unbounded preceding and 1 preceding)"
    ahead = "min(if(base, start, null)) over (partition by row_id order by start desc, score, end, kind desc rows between unbounded preceding and 1 preceding)"
    met = both.withColumn("base_reach", F.expr(reach.format("base"))).withColumn("reach", F.expr(reach.format("true"))).withColumn("ahead", F.expr(ahead))
    return met.filter("base or (coalesce(reach, 0) <= start and coalesce(ahead, end) >= end)").select("row_id", "kind", "base", "start", "end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) per row of ``docs``; the last two as ``kind:start:end`` lists.

    A NULL text is empty; repeated rows are searched one by one, with or without
    an id.  Counts and base_spans are of base spans, spans has all.  Very long texts
    and hosts are searched whole; an empty table gives no rows; other columns are
    not read.
    """
    marked = staged(proposals(docs, id_col, text_col), "proposals")
    spans = detected(marked.filter("size(found) > 0"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    entry = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("text"))
    texts = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda s: s["text"]))
    per_row = spans.groupBy("row_id").agg(
        *[F.count_if(F.expr(f"base and kind = {i}")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        texts(F.collect_list(F.when(F.col("base"), entry))).alias("base_spans"), texts(F.collect_list(entry)).alias("spans"),
    )
    out = marked.select("row_id", "doc_id").join(staged(per_row, "spans"), "row_id", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Rows keep their order of columns, NULL texts stay NULL, and repeated rows stay.
    Columns of any name are passed on.  Empty and very long texts are searched like
    any other, and an empty table gives no rows.  Only rows in which something may
    be found are written and joined.
    """
    columns = docs.columns
    found_col, row_col, cut_col, cuts_col = fresh(docs, "found", "row_id", "cut_id", "cuts")
    found = pinned(docs.withColumn(found_col, _matches(text_col)), found_col)
    some = F.coalesce(F.size(found_col), F.lit(0)) > 0
    clean = found.filter(~some).select(*columns)  # passed on where it is read
    keyed = staged(found.filter(some).withColumn(row_col, F.monotonically_increasing_id()), "keyed")
    marked = keyed.select(F.col(row_col).alias("row_id"), F.col(found_col).alias("found"))
    spans = detected(marked.filter("size(found) > 0"))
    islands = spans.withColumn("opens", F.expr("start >= coalesce(max(end) over (partition by row_id order by start, end, kind rows between unbounded preceding and 1 preceding), 0)"))
    islands = islands.withColumn("island", F.expr("sum(if(opens, 1, 0)) over (partition by row_id order by start, end, kind rows between unbounded preceding and current row)"))
    merged = islands.groupBy("row_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    cuts = staged(merged.groupBy(F.col("row_id").alias(cut_col)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(cuts_col)), "cuts")
    met = keyed.join(cuts, F.col(row_col) == F.col(cut_col), "left")
    mark = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)
    text, list_ = F.col(text_col), F.col(cuts_col)
    last = lambda i: F.when(i == 0, 0).otherwise(F.get(list_, i - 1)["end"])
    pieces = F.transform(list_, lambda c, i: F.concat(F.substring(text, last(i) + 1, c["start"] - last(i)), mark(c["kind"])))
    whole = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(list_, -1)["end"] + 1, F.length(text)))
    return clean.unionByName(met.withColumn(text_col, F.when(list_.isNull(), text).otherwise(whole)).select(*columns))


def op3_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")
