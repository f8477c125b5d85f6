"""Discovery, deduplication, guards, queue and crawl queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import content_fingerprint
from ..functions.urls import normalize_url
from ..operators import frontier as Q
from ..operators import graph as G
from ..operators import guards as GD
from ..options import CrawlOptions
from ..plans.crawl import crawl_graph
from ..sources.robots import robots_rules
from .base import FIXTURES, NOW, nid, query, site
from .urls import AGENT, FP, LINKS, duck_norm

# ---- joins ------------------------------------------------------------------

TARGETS = f"""select event_id, {site('event_id')} as site_id,
  case when event_id % 3 = 0 then 'x' else 'https://' || {site('event_id')} || '.example.com/n/' || cast(event_id % 1997 as string) end as target_identity,
  'https://' || {site('event_id')} || '.example.com/n/' || cast(event_id % 1997 as string) || case when event_id % 1997 % 5 = 0 then '#top' else '' end as target_url
  from {{0}}"""


@query(
    "link_to_node",
    f""", l as ({TARGETS.format('events')}), u as (select site_id, url, min(id) as id from nodes group by all)
 select l.event_id, coalesce(a.id, u.id) as to_id from l left join nodes a on a.site_id = l.site_id and a.identity_key = l.target_identity
   left join u on u.site_id = l.site_id and u.url = l.target_url""",
    "nodes",
)
def _(t):
    return G.resolve_targets(t.sql(TARGETS.format("{events}")), t.nodes).select("event_id", "to_id")


@query("trim_edges", "select e.id, e.from_id, e.to_id from edges e where e.from_id in (select id from eff where not is_deleted) and e.to_id in (select id from eff where not is_deleted)", "eff", "edges")
def _(t):
    return G.trim_edges(t.edges, t.effective.filter(~F.col("is_deleted"))).select("id", "from_id", "to_id")


def redirects(d) -> str:
    c = "c_custkey"
    return f"""select {site(c)} as site_id, {nid(c)} as node_id,
      'https://' || {site(c)} || '.example.com/' || case when {c} % 8 < 4 then 'r/' || cast({c} % 48 as string) else 'n/' || cast(({c} * 4 + {c} % 4) % 3000 as string) end as final_identity,
      {c} as seq from {d.t('customer')} where {c} % 12 < 8"""



FIXTURES["redirects"] = redirects


@query(
    "apply_redirects",
    """, w as (select *, row_number() over (partition by site_id, final_identity order by seq) as rn from redirects),
 o as (select w.*, n.id as owner from w left join nodes n on n.site_id = w.site_id and n.identity_key = w.final_identity)
 select n.id, coalesce(o.final_identity || '?final', n.url) as url,
   case when o.node_id is not null and (o.owner = n.id or (o.owner is null and o.rn = 1)) then o.final_identity else n.identity_key end as identity_key
 from nodes n left join o on o.node_id = n.id""",
    "nodes", "redirects",
)
def _(t):
    r = t.redirects.withColumn("final_url", F.concat("final_identity", F.lit("?final")))
    return G.apply_redirects(t.nodes, r).select("id", "url", "identity_key")


@query(
    "redirect_edges",
    """, r as (select distinct n.site_id, n.id as from_id, m.id as to_id from redirects x join nodes n on n.id = x.node_id join nodes m on m.site_id = x.site_id and m.identity_key = x.final_identity
     union select site_id, from_id, to_id from edges where id % 50 < 5)
 select site_id, from_id, to_id, 'redirect' as source from r where not exists (select 1 from edges e where e.from_id = r.from_id and e.to_id = r.to_id and e.fragment is null)""",
    "nodes", "redirects", "edges",
)
def _(t):
    owners = t.nodes.select("site_id", F.col("identity_key").alias("final_identity"), F.col("id").alias("to_id"))
    hops = t.redirects.join(owners, ["site_id", "final_identity"]).select("site_id", F.col("node_id").alias("from_id"), "to_id")
    some = t.edges.filter("id % 50 < 5").select("site_id", "from_id", "to_id")
    return G.redirect_edges(hops.unionByName(some), t.edges)


# ---- discovery and deduplication ---------------------------------------------


@query(
    "first_parent",
    """, d as (select e.site_id, e.to_id as identity_key, e.from_id, row_number() over (partition by e.site_id, e.to_id order by n.depth, e.from_id, e.id) as rn
   from edges e join nodes n on n.id = e.from_id) select site_id, identity_key, from_id as auto_parent_id from d where rn = 1""",
    "edges", "nodes",
)
def _(t):
    return G.first_discovery(_discoveries(t)).select("site_id", "identity_key", "auto_parent_id")


def _discoveries(t):
    depth = t.nodes.select(F.col("id").alias("from_id"), F.col("depth").alias("from_depth"))
    return t.edges.join(depth, "from_id").select(
        "site_id",
        F.col("to_id").alias("identity_key"),
        "from_id",
        F.struct("from_depth", "from_id").alias("from_rank"),
        F.col("id").alias("order_in_page"),
        (F.col("from_depth") + 1).alias("depth"),
    )


@query("min_depth", "select e.site_id, e.to_id as identity_key, min(n.depth) + 1 as depth from edges e join nodes n on n.id = e.from_id group by all", "edges", "nodes")
def _(t):
    return G.first_discovery(_discoveries(t)).select("site_id", "identity_key", "depth")


@query(
    "bfs_rank",
    "select e.site_id, e.id, cast(row_number() over (partition by e.site_id order by n.depth, e.from_id, e.id) as int) as bfs_rank from edges e join nodes n on n.id = e.from_id",
    "edges", "nodes",
)
def _(t):
    depth = t.nodes.select(F.col("id").alias("from_id"), "depth")
    df = t.edges.drop("order_in_page").join(depth, "from_id").select(
        "site_id", F.col("id"), "depth", F.col("from_id").alias("parent_rank"), F.col("id").alias("order_in_page")
    )
    return G.bfs_rank(df).select("site_id", "id", "bfs_rank")


@query("edge_dedup", ", r as (select *, row_number() over (partition by site_id, from_id, to_id, fragment order by id) as rn from edges) select id, from_id, to_id, fragment, anchor_text from r where rn = 1", "edges")
def _(t):
    return G.dedup_edges(t.edges, F.col("id")).select("id", "from_id", "to_id", "fragment", "anchor_text")


def new_nodes(d) -> str:
    e = "event_id"
    return f"""select md5(cast({e} as string)) as id, {site(e)} as site_id,
      'https://' || {site(e)} || '.example.com/n/' || cast({e} % 3001 as string) as identity_key,
      'u' || cast({e} as string) as url, cast({e} % 5 as int) as depth, {e} as found_seq from {d.t('events')}"""


FIXTURES["new_nodes"] = new_nodes


@query(
    "upsert_nodes",
    """, b as (select id, site_id, identity_key, url, depth, -1 as found_seq from nodes union all select id, site_id, identity_key, url, depth, found_seq from new_nodes)
 select site_id, identity_key, arg_min(id, found_seq) as id, arg_min(url, found_seq) as url, min(depth) as depth from b group by 1, 2""",
    "nodes", "new_nodes",
)
def _(t):
    base = t.nodes.select("id", "site_id", "identity_key", "url", "depth")
    return G.upsert_nodes(base, t.new_nodes)


@query(
    "upsert_materials",
    "select min(id) as id, site_id, node_id, kind, rel_path, arg_max(bytes, id) as bytes, arg_max(sha256, id) as sha256 from materials group by site_id, node_id, kind, rel_path",
    "materials",
)
def _(t):
    m = t.materials
    return G.upsert_materials(m.filter("id % 2 = 0"), m.filter("id % 2 = 1")).select("id", "site_id", "node_id", "kind", "rel_path", "bytes", "sha256")


@query(
    "union_distinct_reach",
    """, em as materialized (select distinct from_id, to_id from edges), seeds as (select id from nodes where auto_parent_id is null),
 r as (select id as root, id from seeds union select r.root, e.to_id from r join em e on e.from_id = r.id) select root, id from r""",
    "nodes", "edges",
)
def _(t):
    seeds = t.nodes.filter("auto_parent_id is null").select(F.col("id").alias("root"), "id")
    relation = t.edges.select(F.col("from_id").alias("parent"), F.col("to_id").alias("child")).distinct()
    return G.reachable(seeds, relation).select("root", "id")


# ---- guards ----------------------------------------------------------------------


@query(
    "content_dedup",
    f", f as (select doc_id, lang as site_id, {FP.format('text')} as fingerprint from documents) select doc_id, coalesce(doc_id > min(doc_id) over (partition by site_id, fingerprint) and fingerprint is not null, false) as is_duplicate from f",
)
def _(t):
    from ..plans.pin import pinned

    docs = t.documents.select(F.col("doc_id").alias("fetch_seq"), F.col("lang").alias("site_id"), content_fingerprint(F.col("text")).alias("fingerprint"))
    return GD.flag_duplicates(pinned(docs, "fingerprint")).select(F.col("fetch_seq").alias("doc_id"), "is_duplicate")


@query("visit_limit", "select id, row_number() over (partition by site_id, identity_key order by id) > 3 as over_limit from fetch_logs", "fetch_logs")
def _(t):
    logs = t.fetch_logs.withColumn("seq", F.col("id"))
    return GD.flag_visits(logs, 3).select("id", "over_limit")


SERIES = "case when id % 3 <> 0 then 'series' || cast(id % 211 as string) end"


@query(
    "pagination_limit",
    f""", l as (select id, site_id, {SERIES} as series_key from fetch_logs), r as (select *, row_number() over (partition by site_id, series_key order by id) as rn from l)
 select id, series_key from r where series_key is null or rn <= 5""",
    "fetch_logs",
)
def _(t):
    links = t.fetch_logs.select("id", "site_id", F.expr(SERIES).alias("series_key"), F.col("id").alias("link_seq"))
    return GD.limit_pagination(links, 5).select("id", "series_key")


PATHNAME = "'/sec' || cast(id % 23 as string) || '/p' || cast(id % 7 as string)"


@query(
    "prefix_prune",
    f""", h as (select site_id, '/sec' || cast(id % 23 as string) as prefix, id as seq, row_number() over (partition by site_id, id % 23 order by id) as rn from fetch_logs where http_status = 200),
 x as (select site_id, prefix, seq as crossed from h where rn = 21)
 select l.id, case when x.crossed < l.id then x.prefix end as pruned_by from fetch_logs l left join x on x.site_id = l.site_id and x.prefix = '/sec' || cast(l.id % 23 as string)""",
    "fetch_logs",
)
def _(t):
    logs = t.fetch_logs.select("id", "site_id", "http_status", F.expr(PATHNAME).alias("pathname"))
    hits = logs.filter("http_status = 200").withColumn("seq", F.col("id"))
    return GD.prune_prefixes(logs.withColumn("from_seq", F.col("id")), hits, 20).select("id", "pruned_by")


@query(
    "retry_plan",
    """select id, attempt <= 2 and (http_status is null or http_status in (408, 425, 429) or http_status >= 500) as retry,
      case when attempt <= 2 and (http_status is null or http_status in (408, 425, 429) or http_status >= 500) then cast(least(1000 * power(2, attempt - 1), 30000) as bigint) else 0 end as delay_ms from fetch_logs""",
    "fetch_logs",
)
def _(t):
    return GD.retry_plan(t.fetch_logs).select("id", "retry", "delay_ms")


# ---- queue ------------------------------------------------------------------------


@query("queue_due", f"select id from queue where state = 'pending' and (next_retry_at is null or next_retry_at <= {NOW})", "queue")
def _(t):
    return Q.queue_due(t.queue, NOW).select("id")


@query(
    "frontier_pick",
    f""", due as (select *, row_number() over (partition by task_id, host order by priority desc, id) as hr from queue where state = 'pending' and (next_retry_at is null or next_retry_at <= {NOW})),
 p as (select *, row_number() over (partition by task_id order by priority desc, id) as r from due where hr <= 2) select task_id, id from p where r <= 20""",
    "queue",
)
def _(t):
    return Q.frontier_pick(t.queue, 20, 2, NOW).select("task_id", "id")


@query("queue_counts", "select task_id, " + ", ".join(f"count(*) filter (where state = '{s}') as {s}" for s in ("pending", "running", "done", "failed", "skipped")) + " from queue group by 1", "queue")
def _(t):
    return Q.queue_counts(t.queue)


@query(
    "enqueue",
    """, n as (select 't' || cast(event_id % 20 as string) as task_id, lpad(cast(user_id as string), 12, '0') as node_id, event_id % 9 as depth from events)
 select task_id, node_id, min(depth) as depth, -min(depth) as priority, 'pending' as state from n where not exists (select 1 from queue q where q.task_id = n.task_id and q.node_id = n.node_id) group by 1, 2""",
    "queue",
)
def _(t):
    new = t.sql("select 't' || cast(event_id % 20 as string) as task_id, lpad(cast(user_id as string), 12, '0') as node_id, 's' as site_id, event_id % 9 as depth from {events}")
    return Q.enqueue(t.queue, new).drop("site_id")


@query("queue_recovery", "select id, case when state = 'running' then 'pending' else state end as state from queue", "queue")
def _(t):
    return Q.recover_queue(t.queue).select("id", "state")


@query(
    "queue_retries",
    f"""select id, case when id % 4 = 1 then 'pending' else state end as state, case when id % 4 = 1 then attempts + 1 else attempts end as attempts,
      case when id % 4 = 1 then {NOW} + id % 100 else next_retry_at end as next_retry_at from queue""",
    "queue",
)
def _(t):
    plan = t.queue.select("id", (F.col("id") % 4 == 1).alias("retry"), (F.col("id") % 100).alias("delay_ms"))
    return Q.apply_retries(t.queue, plan, NOW).select("id", "state", "attempts", "next_retry_at")


@query(
    "host_schedule",
    """, r as (select id, host, row_number() over (partition by host order by priority desc, id) - 1 as p from queue) select id, host, p * 1000 as start_ms, p % 2 as slot from r""",
    "queue",
)
def _(t):
    return Q.schedule(t.queue, 1000, 2).select("id", "host", "start_ms", "slot")


@query(
    "manual_edge_order",
    "select id, case when source = 'manual' then row_number() over (partition by site_id, from_id order by id) - 1 else order_in_page end as order_in_page from edges",
    "edges",
)
def _(t):
    return Q.number_manual_edges(t.edges).select("id", "order_in_page")


# ---- crawl ---------------------------------------------------------------------------

DEPTH = 4


def _levels() -> str:
    """Unrolled breadth-first levels over the edges, for the comparison."""
    out = [
        ", em as materialized (select site_id, from_id, to_id, id from edges)",
        "lv0 as materialized (select site_id, id, cast(null as varchar) as parent, 0 as depth, 1 as place from nodes where auto_parent_id is null)",
    ]
    for i in range(1, DEPTH + 1):
        seen = " union all ".join(f"select id from lv{j}" for j in range(i))
        out.append(
            f"""lv{i} as materialized (select site_id, to_id as id, parent, {i} as depth, row_number() over (partition by site_id order by place, eid) as place from (
   select e.site_id, e.to_id, l.id as parent, l.place, e.id as eid, row_number() over (partition by e.to_id order by l.place, e.id) as rn
   from em e join lv{i - 1} l on l.id = e.from_id where e.to_id not in ({seen})) where rn = 1)"""
        )
    reached = " union all ".join(f"select site_id, id, parent, depth from lv{j}" for j in range(DEPTH + 1))
    out.append(f"reached as materialized ({reached})")
    out.append(
        f"ed as materialized (select distinct e.site_id, e.from_id, e.to_id, e.fragment from edges e join reached r on r.id = e.from_id where r.depth < {DEPTH})"
    )
    return ",\n".join(out)


def linked_pages(t):
    """One stored page per node: its edges, in order, as anchors."""
    frag = F.when(F.col("fragment").isNotNull(), F.concat(F.lit("#"), F.col("fragment"))).otherwise("")
    key = F.regexp_replace("to_id", "^0+(?=.)", "")
    tag = F.concat(F.lit('<a href="/n/'), key, frag, F.lit('">'), F.col("id").cast("string"), F.lit("</a>"))
    bodies = t.edges.groupBy("from_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", tag.alias("tag")))), lambda x: x["tag"]), " ").alias("body"))
    html = F.concat(F.lit("<html><head><title>N</title></head><body>"), F.coalesce("body", F.lit("")), F.lit("</body></html>"))
    nodes = t.nodes
    return nodes.join(bodies, nodes["id"] == bodies["from_id"], "left").select(
        F.col("id").cast("long").alias("page_id"), F.col("identity_key").alias("url"), html.alias("html"),
        F.when(F.col("id").cast("long") % 41 == 7, 404).otherwise(200).alias("http_status"),
    )


def _site_inputs(t):
    return t.sites.select("id", "root_url", "scope", F.lit(None).cast("array<string>").alias("allowlist"))


@query(
    "crawl_graph",
    _levels()
    + """ select r.site_id, n.identity_key, r.depth, p.identity_key as parent_key,
   (select count(*) from ed where ed.to_id = r.id) as in_link_count from reached r join nodes n on n.id = r.id left join nodes p on p.id = r.parent""",
    "nodes", "edges",
)
def crawl_levels(t):
    """Breadth-first graph of every site, guards off."""
    pages = linked_pages(t).drop("http_status")
    nodes, _ = crawl_graph(pages, _site_inputs(t), opts=CrawlOptions(max_depth=DEPTH, guards=False))
    keys = nodes.select(F.col("id").alias("auto_parent_id"), F.col("identity_key").alias("parent_key"))
    return nodes.join(keys, "auto_parent_id", "left").select("site_id", "identity_key", "depth", "parent_key", "in_link_count")


@query(
    "crawl_edges",
    _levels() + " select site_id, f.identity_key as from_key, g.identity_key as to_key, fragment from (select ed.site_id as site_id, fragment, from_id, to_id from ed) x join (select id, identity_key from nodes) f on f.id = x.from_id join (select id, identity_key from nodes) g on g.id = x.to_id",
    "nodes", "edges",
)
def _(t):
    pages = linked_pages(t).drop("http_status")
    nodes, edges = crawl_graph(pages, _site_inputs(t), opts=CrawlOptions(max_depth=DEPTH, guards=False))
    f = nodes.select(F.col("id").alias("from_id"), F.col("identity_key").alias("from_key"))
    g = nodes.select(F.col("id").alias("to_id"), F.col("identity_key").alias("to_key"))
    return edges.join(f, "from_id").join(g, "to_id").select("site_id", "from_key", "to_key", "fragment")


@query("crawl_guarded")
def _(t):
    """All guards on, over the same linked pages: robots, budgets, pruning, copies."""
    robots = t.sites.select(
        F.concat(F.lit("https://"), F.col("root_host")).alias("origin"),
        F.lit("User-agent: *\nDisallow: /n/11\nAllow: /n/117").alias("text"),
    )
    opts = CrawlOptions(max_depth=DEPTH, prefix_prune_threshold=150, max_pages=250)
    nodes, _ = crawl_graph(linked_pages(t), _site_inputs(t), robots_rules(robots, AGENT), opts)
    return nodes.select("site_id", "identity_key", "depth", "status", "in_link_count", "out_link_count")


@query(
    "crawl_pages",
    ", " + LINKS + ", " + duck_norm("s", "(select page_id, url from pages)", "url")
    + """, first as (select *, row_number() over (partition by ident order by page_id) as copy from s),
 roots as (select nhost as site_id, ident as root_key, page_id, row_number() over (partition by nhost order by page_id) as rn from first where copy = 1), """
    + duck_norm("l", "abs_links", "target_url")
    + """ select r.site_id, 1 + count(distinct l.ident) filter (where l.ident <> r.root_key) as nodes, count(*) as links from roots r join l on l.page_id = r.page_id where r.rn = 1 and l.nhost = r.site_id group by 1""",
)
def _(t):
    """Crawl of the raw pages: every host is a site rooted at its first stored page."""
    keyed = normalize_url(t.pages.select("page_id", "url"), "url", "n")
    firsts = keyed.groupBy(F.col("n.normalized_host").alias("id")).agg(F.min_by("url", "page_id").alias("root_url"))
    sites = firsts.select("id", "root_url", F.lit("same_site").alias("scope"), F.lit(None).cast("array<string>").alias("allowlist"))
    nodes, edges = crawl_graph(t.pages, sites, opts=CrawlOptions(max_depth=1))
    return nodes.groupBy("site_id").agg(F.count("*").alias("nodes"), F.sum("out_link_count").alias("links"))
