"""Breadth-first site graphs from stored pages.

One round per depth (at most 20), each round a fixed set of joins over written
tables.  Page order inside a site is the queue order: depth, then discovery
(place of the linking page, position of the link).  A page's place is written
as a sortable key: its depth, then the link positions that lead to it.  So no
page is ever numbered by a window over a whole site.  All order-dependent
guards use that order; the result is the one a single worker would produce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import (
    NON_CONTENT_TAGS,
    content_class,
    content_fingerprint,
    extract_content,
    links_of,
    number_links,
    page_anchors,
    page_text,
)
from ..functions.urls import display_label, first_segment, in_scope, is_asset_url, node_id, normalize_url, pagination
from ..operators.guards import _nth, limit_pagination
from ..options import CrawlOptions
from ..sources.robots import robots_allowed
from .pin import pinned
from .stage import buckets, is_empty, staged, staged_by

_STEP = 8  # hex digits of one link position in a place key: all of a 32-bit number
_DEPTH = 6  # digits of the depth in front of it


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def page_index(pages: DataFrame, opts: CrawlOptions) -> tuple[DataFrame, DataFrame]:
    """(index, links): stored pages by identity, and the links of each page.

    ``page_id`` must be unique; final_url, http_status and content_type are
    optional.  Page texts are read once and parsed where they are read: only
    slim rows are stored and shuffled, never html.  Both tables are bucketed by
    their join key, so the rounds of the crawl do not shuffle them again.
    """
    if "page_id" not in pages.columns:
        raise ValueError("pages need a unique page_id")
    defaults = {"final_url": F.col("url"), "http_status": F.lit(200), "content_type": F.lit("text/html")}
    for name, value in defaults.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    norm = dict(drop_www=opts.drop_www, force_https=opts.force_https, blacklist=opts.tracking_blacklist)
    pages = pages.select(
        "page_id", "url", F.coalesce("final_url", "url").alias("final_url"), "http_status", "content_type", "html"
    )
    n_buckets = buckets(pages.sparkSession)

    content = extract_content(pages)
    body = F.when(F.col("text") != "", F.col("text")).otherwise(page_text(F.col("html"), NON_CONTENT_TAGS))
    content = pinned(content.withColumn("content_hash", content_fingerprint(body)), "content_hash")
    facts = ("page_id", "url", "final_url", "http_status", "content_type", "title", "content_hash", "has_html")
    content = content.withColumn("has_html", F.col("html").isNotNull())
    # the only pass over page texts
    parsed = staged(page_anchors(content, "html", "final_url", keep=facts), "parsed")

    links = links_of(parsed.select("page_id", "_page", "_base_href", "_anchors"), keep=("page_id",))
    links = number_links(links.repartition(n_buckets, "page_id"), "page_id")
    links = normalize_url(links, "url", "n", **norm).filter(F.col("n").isNotNull())
    links = pagination(links.withColumn("identity_key", F.col("n.identity_key")), "identity_key", "pg")
    links = links.select(
        "page_id",
        "order_in_page",
        "anchor_text",
        "rel",
        "target",
        "is_nofollow",
        "fragment",
        "identity_key",
        F.col("n.url").alias("url"),
        F.col("n.normalized_host").alias("host"),
        F.col("pg.series_key").alias("series_key"),
        first_segment(F.col("n.pathname")).alias("prefix"),
    )
    links = staged_by(links, "page_id", "links")

    content = parsed.select(*facts)
    content = normalize_url(normalize_url(content, "url", "n", **norm), "final_url", "fin", **norm)
    slim = content.filter(F.col("n").isNotNull()).select(
        F.col("n.identity_key").alias("identity_key"),
        "page_id",
        F.col("fin.url").alias("final_url"),
        F.coalesce("fin.identity_key", "n.identity_key").alias("final_key"),
        first_segment(F.col("fin.pathname")).alias("final_prefix"),
        "http_status",
        "content_type",
        content_class(F.col("content_type")).alias("klass"),
        "has_html",
        "title",
        "content_hash",
    )
    # a page stored twice under one identity: the first copy counts
    rest = [c for c in slim.columns if c not in ("identity_key", "page_id")]
    chosen = slim.groupBy("identity_key").agg(
        F.min("page_id").alias("page_id"), F.min_by(F.struct(*rest), "page_id").alias("r")
    )
    outs = links.groupBy(F.col("page_id").alias("_p")).agg(F.count("*").alias("out_link_count"))
    index = chosen.join(outs, chosen["page_id"] == outs["_p"], "left").select(
        "identity_key",
        "page_id",
        *[F.col(f"r.{c}").alias(c) for c in rest],
        F.coalesce("out_link_count", F.lit(0)).alias("out_link_count"),
    )
    return staged_by(index.repartition(n_buckets, "identity_key"), "identity_key", "index"), links


def crawl_graph(
    pages: DataFrame,
    sites: DataFrame,
    robots: DataFrame | None = None,
    opts: CrawlOptions | None = None,
    visits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every site, breadth-first from its root.

    ``pages``: see ``page_index``.  ``sites``: id, root_url, scope, allowlist.  ``robots``: rules per origin.
    ``visits``: earlier visit counts (site_id, identity_key, visits).  Linked
    pages that are not stored stay ``queued``.  A redirected page keeps its
    node; links to its old address keep leading to it.
    """
    opts = opts or CrawlOptions()
    index, links = page_index(pages, opts)
    norm = dict(drop_www=opts.drop_www, force_https=opts.force_https, blacklist=opts.tracking_blacklist)
    rooted = normalize_url(sites.select("id", "root_url", "scope", "allowlist"), "root_url", "n", **norm)
    rooted = rooted.filter(F.col("n").isNotNull())
    rules = staged(
        rooted.select(F.col("id").alias("site_id"), F.col("n.normalized_host").alias("root_host"), "scope", "allowlist"),
        "sites",
    )
    frontier = staged(
        rooted.select(
            F.col("id").alias("site_id"),
            F.col("n.identity_key").alias("identity_key"),
            F.col("n.url").alias("url"),
            F.lit(None).cast("string").alias("parent_id"),
            F.lit(0).alias("depth"),
            F.lit("0" * _DEPTH).alias("seq"),
        ),
        "frontier",
    )
    seen: list[DataFrame] = [frontier.select("site_id", "identity_key")]
    handled: list[DataFrame] = []
    edges: list[DataFrame] = []
    spent: list[DataFrame] = []
    moved: list[DataFrame] = []
    has_series = not is_empty(links.filter(F.col("series_key").isNotNull()))
    total = frontier.count()

    for depth in range(opts.max_depth + 1):
        level = _handle(frontier, index, handled, robots, visits, opts, opts.max_pages is not None and total >= opts.max_pages)
        handled.append(level)
        if depth == opts.max_depth:
            break
        passed = _expand(level, handled, links, rules, spent, opts, has_series)
        if has_series:
            spent.append(
                passed.filter(F.col("series_key").isNotNull())
                .groupBy("site_id", "series_key")
                .agg(F.count("*").alias("used"))
            )
        # who claims an unowned identity first: a link, or a redirect of a handled page
        claims = passed.select(
            "site_id", "identity_key", "from_seq", "order_in_page", "from_id", "url"
        ).unionByName(
            level.filter(F.col("redirected")).select(
                "site_id",
                F.col("final_key").alias("identity_key"),
                F.col("seq").alias("from_seq"),
                F.lit(-1).alias("order_in_page"),
                F.col("id").alias("from_id"),
                F.col("final_url").alias("url"),
            )
        )
        place = F.struct("from_seq", "order_in_page")
        firsts = (
            claims.groupBy("site_id", "identity_key")
            .agg(F.min(place).alias("at"), F.min_by(F.struct("from_id", "url"), place).alias("by"))
            .join(_union(seen), ["site_id", "identity_key"], "left_anti")
            .select(
                "site_id",
                "identity_key",
                F.col("at.from_seq").alias("from_seq"),
                F.col("at.order_in_page").alias("order_in_page"),
                F.col("by.from_id").alias("from_id"),
                F.col("by.url").alias("url"),
            )
        )
        firsts = staged(firsts, "firsts")
        taken = firsts.filter(F.col("order_in_page") == -1).select(
            "site_id", "identity_key", F.col("from_id").alias("owner_id")
        )
        moved.append(taken)
        owners = _union(moved)
        place_key = F.concat(
            F.lpad(F.lit(depth + 1).cast("string"), _DEPTH, "0"),
            F.substring("from_seq", _DEPTH + 1, 1 << 30),
            F.lpad(F.hex("order_in_page"), _STEP, "0"),
        )
        frontier = firsts.filter(F.col("order_in_page") >= 0).select(
            "site_id",
            "identity_key",
            "url",
            F.col("from_id").alias("parent_id"),
            F.lit(depth + 1).alias("depth"),
            place_key.alias("seq"),
        )
        found = frontier.count()
        total += found
        seen.append(firsts.select("site_id", "identity_key"))
        edges.append(
            passed.join(owners, ["site_id", "identity_key"], "left").select(
                "site_id",
                "from_id",
                F.coalesce("owner_id", node_id(F.col("site_id"), F.col("identity_key"))).alias("to_id"),
                "fragment",
                "from_seq",
                "order_in_page",
                "anchor_text",
                "rel",
                "target",
                "is_nofollow",
            )
        )
        if not found:
            break

    return _finish(handled, edges, moved, norm, links)


def _handle(frontier, index, handled, robots, visits, opts, may_be_full) -> DataFrame:
    """Outcome of each page of one depth, in queue order."""
    df = frontier.join(index, "identity_key", "left").withColumn(
        "id", node_id(F.col("site_id"), F.col("identity_key"))
    )
    if robots is not None and opts.respect_robots and opts.guards:
        df = robots_allowed(df, robots, "url")
    else:
        df = df.withColumn("robots_allowed", F.lit(True))
    if visits is not None and opts.guards:
        df = df.join(visits.select("site_id", "identity_key", "visits"), ["site_id", "identity_key"], "left")
    else:
        df = df.withColumn("visits", F.lit(0))
    fetched = F.col("final_key").isNotNull()
    limited = opts.guards and opts.visit_limit is not None
    outcome = F.when(F.coalesce("visits", F.lit(0)) + 1 > opts.visit_limit, "skipped") if limited else F.when(F.lit(False), "")
    outcome = (
        outcome.when(is_asset_url(F.col("url")), "skipped")
        .when(~F.col("robots_allowed"), "blocked")
        .when(~fetched, "queued")
        .when(F.col("klass") == "asset", "counted-skip")
        .when((F.col("http_status") >= 400) | ~F.col("has_html"), "error")
        .otherwise("ok")
    )
    df = df.withColumn("outcome", outcome).withColumn("counted", F.col("outcome").isin("counted-skip", "error", "ok"))
    columns = [
        "site_id", "identity_key", "url", "parent_id", "depth", "seq", "id", "final_url", "final_key", "final_prefix",
        "page_id", "http_status", "content_type", "title", "content_hash", "out_link_count", "outcome", "counted",
    ]
    level = df.select(*columns)
    if opts.guards:
        if may_be_full:
            level = staged(_stop_at_max_pages(staged(level, "level"), handled, opts), "level")
        level = _drop_copies(level, handled)
    else:
        level = level.withColumn("status", F.col("outcome")).withColumn("is_copy", F.lit(False))
    status = F.when(F.col("status") == "counted-skip", "skipped").otherwise(F.col("status"))
    fetched_rows = F.col("counted") & (F.col("status") != "queued")
    level = level.withColumn("status", status).withColumn(
        "redirected", F.coalesce(fetched_rows & (F.col("final_key") != F.col("identity_key")), F.lit(False))
    )
    return staged(level, "handled")


def _stop_at_max_pages(level: DataFrame, handled: list[DataFrame], opts: CrawlOptions) -> DataFrame:
    """The item after the last allowed page is skipped, everything later stays queued."""
    frames = [h.select("site_id", "seq", "counted", "depth") for h in [*handled, level]]
    counted = _union(frames).filter(F.col("counted"))
    full = staged(
        counted.groupBy("site_id").agg(F.count("*").alias("n")).filter(F.col("n") >= opts.max_pages), "full"
    )
    if is_empty(full):
        return level
    cut = _nth(counted.join(full, "site_id", "left_semi"), ["site_id"], "seq", opts.max_pages, "cut")
    beyond = level.join(cut, "site_id").filter(F.col("seq") > F.col("cut"))
    stops = beyond.groupBy("site_id").agg(F.min("seq").alias("stop"))
    joined = level.join(stops, "site_id", "left")
    status = (
        F.when(F.col("seq") == F.col("stop"), "skipped")
        .when(F.col("seq") > F.col("stop"), "queued")
        .otherwise(F.col("outcome"))
    )
    return joined.select(
        *[level[c] for c in level.columns if c not in ("outcome", "counted")],
        status.alias("outcome"),
        F.when(F.col("seq") >= F.col("stop"), False).otherwise(F.col("counted")).alias("counted"),
    )


def _drop_copies(level: DataFrame, handled: list[DataFrame]) -> DataFrame:
    """Later pages with a content hash of an ok page of the site are skipped and not expanded."""
    cols = ["site_id", "content_hash", "seq"]
    fresh = level.filter((F.col("outcome") == "ok") & F.col("content_hash").isNotNull()).select(*cols)
    old = [h.filter((F.col("status") == "ok") & F.col("content_hash").isNotNull()).select(*cols) for h in handled]
    firsts = (
        _union([fresh, *old])
        .groupBy(F.col("site_id").alias("_s"), F.col("content_hash").alias("_h"))
        .agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
    )
    on = (F.col("site_id") == F.col("_s")) & (F.col("content_hash") == F.col("_h"))
    copy = F.coalesce((F.col("outcome") == "ok") & (F.col("seq") > F.col("_first")), F.lit(False))
    known = level.filter(F.col("content_hash").isNotNull())
    joined = known.join(firsts, on, "left").withColumn("is_copy", copy)
    compared = joined.select(
        *[known[c] for c in level.columns],
        F.when(F.col("is_copy"), "skipped").otherwise(F.col("outcome")).alias("status"),
        "is_copy",
    )
    # rows without a hash take no part in the join, where they would all meet
    others = level.filter(F.col("content_hash").isNull())
    return compared.unionByName(others.select("*", F.col("outcome").alias("status"), F.lit(False).alias("is_copy")))


def _expand(level, handled, links, rules, spent, opts, has_series) -> DataFrame:
    """Links of the ok pages that pass scope, pruning and pagination, in order."""
    ok = level.filter(F.col("status") == "ok").select(
        "site_id", "page_id", F.col("id").alias("from_id"), F.col("seq").alias("from_seq")
    )
    found = ok.join(links, "page_id").join(rules, "site_id")
    found = found.filter(in_scope(F.col("host"), F.col("root_host"), F.col("scope"), F.col("allowlist"))).drop(
        "page_id", "host", "root_host", "scope", "allowlist"
    )
    if not opts.guards:
        return staged(found, "passed")
    if opts.prefix_prune_threshold is not None:
        found = _prune(found, handled, opts.prefix_prune_threshold)
    if not has_series or opts.pagination_page_limit is None:
        return staged(found, "passed")
    carried = None
    if spent:
        carried = _union(spent).groupBy("site_id", "series_key").agg(F.sum("used").alias("used"))
    passed = limit_pagination(
        staged(found, "found"), opts.pagination_page_limit, carried, order=("from_seq", "order_in_page")
    )
    return staged(passed, "passed")


def _prune(found: DataFrame, handled: list[DataFrame], threshold: int) -> DataFrame:
    """Without links into a first path segment that had crossed the threshold before their page's turn."""
    hits = _union(
        [
            h.filter((F.col("status") == "ok") & F.col("final_prefix").isNotNull()).select(
                "site_id", F.col("final_prefix").alias("prefix"), "seq"
            )
            for h in handled
        ]
    )
    crossed = _nth(hits, ["site_id", "prefix"], "seq", threshold + 1, "crossed_at")
    return (
        found.join(crossed, ["site_id", "prefix"], "left")
        .filter(F.col("crossed_at").isNull() | (F.col("crossed_at") >= F.col("from_seq")))
        .drop("crossed_at")
    )


def _finish(handled, edges, moved, norm, links) -> tuple[DataFrame, DataFrame]:
    nodes = _union(handled)
    strings = ", ".join(f"{c} string" for c in ("site_id", "from_id", "to_id", "fragment", "from_seq"))
    if edges:
        all_edges = _union(edges)
    else:  # depth 0: the roots alone
        fields = links.select("order_in_page", "anchor_text", "rel", "target", "is_nofollow").schema
        schema = ", ".join([strings, *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])
        all_edges = nodes.sparkSession.createDataFrame([], schema)
        moved = [nodes.limit(0).select("site_id", "identity_key", F.col("id").alias("owner_id"))]
    keys = ["site_id", "from_id", "to_id", "fragment"]
    rest = ["from_seq", "order_in_page", "anchor_text", "rel", "target", "is_nofollow"]
    all_edges = staged(
        all_edges.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct("from_seq", "order_in_page")).alias("r"))
        .select(*keys, *[f"r.{c}" for c in rest])
        .withColumn("source", F.lit("auto")),
        "edges",
    )
    owners = _union(moved).select("site_id", F.col("identity_key").alias("new_key"), F.col("owner_id").alias("id"))
    ins = all_edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_link_count"))
    shown = (F.col("status") == "ok") | F.col("is_copy")
    nodes = nodes.join(owners, ["site_id", "id"], "left").join(ins, "id", "left")
    nodes = nodes.withColumn("url", F.when(F.col("redirected"), F.col("final_url")).otherwise(F.col("url")))
    nodes = normalize_url(nodes, "url", "n", **norm)
    return (
        nodes.select(
            "id",
            "site_id",
            F.coalesce("new_key", "identity_key").alias("identity_key"),
            "url",
            display_label(
                F.lit(None).cast("string"), F.when(shown, F.col("title")), F.col("n"), F.col("url")
            ).alias("display_label"),
            F.when(shown, F.col("title")).alias("title"),
            F.when(F.col("counted"), F.col("http_status")).alias("http_status"),
            F.when(F.col("counted"), F.col("content_type")).alias("content_type"),
            "depth",
            F.col("parent_id").alias("auto_parent_id"),
            "status",
            F.when(shown, F.col("content_hash")).alias("content_hash"),
            F.coalesce("in_link_count", F.lit(0)).alias("in_link_count"),
            F.when(F.col("status") == "ok", F.col("out_link_count")).otherwise(F.lit(0)).alias("out_link_count"),
            F.col("seq").alias("place"),
        ),
        all_edges,
    )
