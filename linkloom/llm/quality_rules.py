"""Quality rules with thresholds that follow the data of each language and source.

Shares of a document (symbols, repeated lines, ...) are counted into quantile
sketches with logarithmic bins: a value lies in bin floor(log(x) / log(GAMMA)),
so a quantile read from the counts has a relative error below GAMMA - 1, and
sketches merge by adding counts.  A (language, source) pair with fewer than
``MIN_DOCS`` documents takes the merged sketch of its language.  Fences lie
``REACH`` interquartile ranges beyond the quartiles, at least the least width of
the statistic; documents are then joined with the fences of their pair.

Everything is DataFrame operations; texts are read once, and what is written and
shuffled are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pin import let
from .common import staged, table

GAMMA = 1.02
REACH = 4.0
MIN_DOCS = 100
WINDOW = 8
ZERO_BIN = -1_000_000
#: Statistic: (expression, least distance of the fence from the quartile, whether low values are odd too).
STATISTICS = {
    "word_length": ("word_chars / n_words", 2.0, True),
    "symbols": ("n_symbols / n_words", 0.2, False),
    "dup_lines": ("n_dup_lines / n_lines", 0.5, False),
    "repeats": ("n_repeat_words / n_words", 0.3, False),
}

_WHITE = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which one
    pass of ``array_distinct`` shows; only for the others are windows sorted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            same = F.filter(p, lambda x, j: F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(pairs, repeated), length)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= window, 0).otherwise(some)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, _WHITE) != "")
    packed = F.struct(
        let(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("again"))).alias("words"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("lines"),
    )
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.length(_without(text, _WHITE)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("bigint").alias("n_symbols"),
        packed.alias("p"),
    ).select(
        "doc_id", "lang", "source", F.col("p.words.n").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.col("p.lines.n").cast("bigint").alias("n_lines"), F.col("p.lines.again").cast("bigint").alias("n_dup_lines"),
        F.col("p.words.again").cast("bigint").alias("n_repeat_words"),
    )


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _bin(x: str) -> str:
    return f"case when {x} <= 0 then {ZERO_BIN} else cast(floor(ln({x}) / ln({GAMMA})) as bigint) end"


def _value(b: str) -> str:
    return f"case when {b} = {ZERO_BIN} then 0.0 else power({GAMMA}, {b} + 0.5) end"


def sketch(seen: DataFrame) -> DataFrame:
    """(lang, source, stat, bin, n): one count per pair, statistic and bin over rows that pass the base rules."""
    stats = ", ".join(f"struct('{k}' as stat, {_bin(x)} as bin)" for k, (x, _, _) in STATISTICS.items())
    return (
        seen.filter(f"not ({BASE_FAILED})").selectExpr("lang", "source", f"inline(array({stats}))")
        .groupBy("lang", "source", "stat", "bin").agg(F.count("*").alias("n"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, and low/high of each statistic) for every pair in ``sketches``."""
    size = "sum(if(stat = 'symbols', n, 0)) over (partition by lang, source)"
    own = sketches.withColumn("docs", F.expr(size))
    merged = sketches.groupBy("lang", "stat", "bin").agg(F.sum("n").alias("n"))
    few = own.filter(f"docs < {MIN_DOCS}").select("lang", "source").distinct()
    lent = few.join(merged, few.lang.eqNullSafe(merged.lang)).select(few.lang, few.source, "stat", "bin", "n")
    used = own.filter(f"docs >= {MIN_DOCS}").select("lang", "source", "stat", "bin", "n").unionByName(lent)
    ranked = used.withColumn("upto", F.expr("sum(n) over (partition by lang, source, stat order by bin)")).withColumn("total", F.expr("sum(n) over (partition by lang, source, stat)"))
    quartiles = (
        ranked.groupBy("lang", "source", "stat")
        .agg(F.min(F.expr("if(4 * upto >= total, bin, null)")).alias("b1"), F.min(F.expr("if(4 * upto >= 3 * total, bin, null)")).alias("b3"))
        .withColumn("q1", F.expr(_value("b1"))).withColumn("q3", F.expr(_value("b3")))
    )
    columns = []
    for k, (_, least, low) in STATISTICS.items():
        reach = f"greatest({REACH} * (q3 - q1), {least})"
        columns.append(F.max(F.expr(f"if(stat = '{k}', q3 + {reach}, null)")).alias(f"{k}_high"))
        if low:
            columns.append(F.max(F.expr(f"if(stat = '{k}', q1 - {reach}, null)")).alias(f"{k}_low"))
    return quartiles.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*columns)


def verdict() -> str:
    tests = [f"{x} <= {k}_high" for k, (x, _, _) in STATISTICS.items()] + [f"{x} >= {k}_low" for k, (x, _, low) in STATISTICS.items() if low]
    return " and ".join(tests)


def judged(docs: DataFrame) -> DataFrame:
    """Counts of every row, ``base_failed`` and ``kept``.

    A NULL or empty text has no words and fails the base rules.  NULL languages
    and sources are values of their own.  Rows that repeat are judged, and
    counted, one by one.  An empty table gives no rows.
    """
    seen = staged(counts(docs), "counts")
    limits = staged(fences(staged(sketch(seen), "sketch")), "fences")
    met = seen.join(limits, seen.lang.eqNullSafe(limits.f_lang) & seen.source.eqNullSafe(limits.f_source), "left")
    return met.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(f"if(base_failed, false, {verdict()})"))


def op1_adaptive_quality_rules(spark, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(table(spark, sf_dir, "documents")).select(*names)


def _duck_fence(k: str) -> str:
    _, least, low = STATISTICS[k]
    reach = f"greatest({REACH} * (q3 - q1), {least})"
    parts = [f"max(case when stat = '{k}' then q3 + {reach} end) as {k}_high"]
    return ", ".join(parts + ([f"max(case when stat = '{k}' then q1 - {reach} end) as {k}_low"] if low else []))


OP1_SQL = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
 win as (select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
 again as (select doc_id, i, count(*) over (partition by doc_id, g) as c from win),
 rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from again where c > 1) group by doc_id),
 s as (select d.doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words from d left join rep using (doc_id)),
 b as (select *, {BASE_FAILED} as base_failed from s),
 bins as (select lang, source, stat, bin, count(*) as n from (
    {" union all ".join(f"select lang, source, '{k}' as stat, {_bin(x)} as bin from b where not base_failed" for k, (x, _, _) in STATISTICS.items())})
    group by all),
 own as (select *, sum(case when stat = 'symbols' then n else 0 end) over (partition by lang, source) as docs from bins),
 used as (select lang, source, stat, bin, n from own where docs >= {MIN_DOCS}
    union all select f.lang, f.source, m.stat, m.bin, m.n from (select distinct lang, source from own where docs < {MIN_DOCS}) f
      join (select lang, stat, bin, sum(n) as n from bins group by all) m on f.lang is not distinct from m.lang),
 ranked as (select *, sum(n) over (partition by lang, source, stat order by bin) as upto, sum(n) over (partition by lang, source, stat) as total from used),
 q as (select lang, source, stat, min(case when 4 * upto >= total then bin end) as b1, min(case when 4 * upto >= 3 * total then bin end) as b3
    from ranked group by all),
 v as (select lang, source, stat, {_value('b1')} as q1, {_value('b3')} as q3 from q),
 f as (select lang, source, {", ".join(_duck_fence(k) for k in STATISTICS)} from v group by lang, source)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else {verdict()} end as kept
from b left join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source"""
