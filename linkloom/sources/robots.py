"""robots.txt texts as a table: rules per origin, and their use on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_path


def robots_lines(texts: DataFrame) -> DataFrame:
    """(origin, text) → (origin, line_no, field, value, group_no) for usable lines.

    One window per origin; a robots file is small by definition (readers cap it
    at half a megabyte), so no origin is large.
    """
    lines = texts.select("origin", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("origin", "line_no", clean.alias("clean")).filter(F.locate(":", F.col("clean")) > 0)
    lines = lines.select(
        "origin",
        "line_no",
        F.lower(F.trim(F.substring_index("clean", ":", 1))).alias("field"),
        F.trim(F.regexp_replace("clean", "^[^:]*:", "")).alias("value"),
    )
    ordered = Window.partitionBy("origin").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    groupable = lines.filter(F.col("field") != "sitemap")
    starts = is_agent & (F.coalesce(F.lag("field").over(ordered), F.lit("")) != "user-agent")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groupable.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(running)).drop("starts")


def sitemaps(texts: DataFrame) -> DataFrame:
    lines = texts.select("origin", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    is_sitemap = F.lower(clean).rlike(r"^sitemap\s*:")
    return lines.filter(is_sitemap).select(
        "origin", "line_no", F.trim(F.regexp_replace(clean, "^[^:]*:", "")).alias("sitemap")
    )


def robots_rules(texts: DataFrame, user_agent: str) -> DataFrame:
    """Rules of the best matching group of each origin.

    Longest agent contained in the user agent wins, ``*`` counts 0, earliest
    wins ties.  Origins without a matching group have no rows (all allowed).
    """
    lines = robots_lines(texts)
    agent = F.lower("value")
    ua = F.lit(user_agent.lower())
    agents = lines.filter((F.col("field") == "user-agent") & ((agent == "*") | F.contains(ua, agent)))
    weight = F.when(agent == "*", 0).otherwise(F.length("value"))
    best = agents.groupBy("origin").agg(
        F.max_by("group_no", F.struct(weight, -F.col("line_no"))).alias("group_no")
    )
    chosen = lines.filter((F.col("group_no") > 0) & (F.col("field") != "user-agent")).join(best, ["origin", "group_no"])
    seconds = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    delays = (
        chosen.filter(seconds >= 0)
        .groupBy("origin")
        .agg(F.max_by(F.round(seconds * 1000).cast("long"), "line_no").alias("crawl_delay_ms"))
    )
    rules = chosen.filter(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.join(delays, "origin", "left").select(
        "origin",
        (F.col("field") == "allow").alias("allow"),
        F.col("value").alias("path"),
        rule_weight(F.col("value")).alias("weight"),
        "crawl_delay_ms",
        "line_no",
    )


def rule_weight(path: Column) -> Column:
    return F.length(F.regexp_replace(path, "[*$]", ""))


def rule_regex(path: Column) -> Column:
    """Anchored regular expression of a robots rule (``*`` wildcard, trailing ``$``)."""
    anchored = path.endswith("$")
    bare = F.regexp_replace(path, r"\$$", "")
    escaped = F.regexp_replace(bare, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.when(path == "/", F.lit("^")).otherwise(
        F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(""))
    )


def rule_matches(target: Column, rule: Column) -> Column:
    """Does a rule match path+query?  Plain prefixes avoid the regex engine."""
    plain = ~F.contains(rule, F.lit("*")) & ~rule.endswith("$")
    return F.when((rule == "/") | (plain & target.startswith(rule)), True).when(plain, False).otherwise(
        F.rlike(target, rule_regex(rule))
    )


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``robots_allowed``: longest matching rule wins, Allow wins ties.

    The rules of an origin travel as one array (a robots file is bounded), so
    each page stays one row: no page × rule rows, no second shuffle.
    """
    packed = rules.groupBy("origin").agg(
        F.collect_set(F.struct("weight", "allow", "path", rule_regex(F.col("path")).alias("regex"))).alias("_rules")
    )
    target = F.concat(url_path(F.col(url)), F.regexp_extract(url, r"(\?[^#]*)", 1))
    with_target = pages.withColumn("_origin", F.regexp_extract(url, "^([^:]+://[^/?#]+)", 1)).withColumn("_target", target)
    plain = lambda r: ~F.contains(r["path"], F.lit("*")) & ~r["path"].endswith("$")
    hit = lambda r: F.when(plain(r), F.col("_target").startswith(r["path"])).otherwise(
        F.rlike(F.col("_target"), r["regex"])
    )
    best = F.array_max(
        F.transform(F.filter("_rules", hit), lambda r: F.struct(r["weight"].alias("w"), r["allow"].alias("a")))
    )["a"]
    joined = with_target.join(packed, with_target["_origin"] == packed["origin"], "left")
    return joined.select(
        *[with_target[c] for c in pages.columns], F.coalesce(best, F.lit(True)).alias("robots_allowed")
    )
