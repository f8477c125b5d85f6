"""Effective view, corrections, browsing, statistics and layouts over the derived node tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators import browse as B
from ..operators import corrections as C
from ..operators import effective as E
from ..operators import graph as G
from ..operators import layout as L
from ..operators import stats as S
from ..plans.stage import new_path
from ..sources.tables import scan_table, write_table
from .base import FIXTURES, idiv, nid, query
from .urls import duck_norm

EFF_COLUMNS = (
    "id, site_id, url, alias, display_label, title, effective_parent_id, is_deleted, has_override"
)


# ---- sources and the effective view ---------------------------------------


@query("scan_tables", "select site_id, count(*) as n, cast(sum(depth) as bigint) as depths, count(last_fetch_at) as fetched from nodes group by 1", "nodes")
def _(t):
    path = new_path(t.spark, "tables")
    write_table(t.nodes, path, "nodes")
    return scan_table(t.spark, path, "nodes").groupBy("site_id").agg(
        F.count("*").alias("n"), F.sum("depth").alias("depths"), F.count("last_fetch_at").alias("fetched")
    )


@query("effective_nodes", f"select {EFF_COLUMNS} from eff", "eff")
def _(t):
    return t.effective.select(*EFF_COLUMNS.split(", "))


@query("has_override", "select n.id, exists (select 1 from overrides o where o.node_id = n.id and o.field = 'alias' and not o.undone) as has_override from nodes n", "nodes", "overrides")
def _(t):
    return E.with_has_override(t.nodes, t.overrides, "alias").select("id", "has_override")


@query("latest_override", ", ov as (select *, row_number() over (partition by node_id, field order by seq desc, id desc) as rn from overrides where not undone) select node_id, field, value, seq from ov where rn = 1", "overrides")
def _(t):
    return E.latest_overrides(t.overrides).select("node_id", "field", "value", "seq")


@query("child_count", "select e.id, (select count(*) from eff c where c.effective_parent_id = e.id and not c.is_deleted) as child_count from eff e", "eff")
def _(t):
    return E.with_child_count(t.effective).select("id", "child_count")


@query("is_crawled", "select id, last_fetch_at is not null and status in ('ok', 'error', 'need_human') as crawled from nodes", "nodes")
def _(t):
    return t.nodes.select("id", E.is_crawled(F.col("status"), F.col("last_fetch_at")).alias("crawled"))


# ---- browsing ---------------------------------------------------------------


@query(
    "children_page",
    """, live as (select site_id, effective_parent_id, id, row_number() over (partition by site_id, effective_parent_id order by depth, id) - 1 as rn from eff where not is_deleted)
 select site_id, effective_parent_id, id, cast(floor(rn / 5) as int) as page, rn % 5 as pos from live""",
    "eff",
)
def _(t):
    return B.children_pages(t.effective, page_size=5)


@query(
    "children_one_page",
    """, live as (select *, row_number() over (order by depth, id) as rn, count(*) over () as total from eff
   where not is_deleted and site_id = 's1' and effective_parent_id = '000000000001')
 select id, depth, total from live where rn between 2 and 4""",
    "eff",
)
def _(t):
    return B.children_page(t.effective, "s1", "0" * 11 + "1", offset=1, limit=3).select("id", "depth", "total")


@query(
    "flat_tree",
    """, live as (select *, row_number() over (partition by site_id order by depth, id) as rn, count(*) over (partition by site_id) as total from eff where not is_deleted)
 select site_id, id, depth, total, total > 200 as truncated from live where rn <= 200""",
    "eff",
)
def _(t):
    return B.flat_tree(t.effective, limit=200).select("site_id", "id", "depth", "total", "truncated")


SEARCHED = "contains(lower(coalesce(url, '')), '{0}') or contains(lower(coalesce(display_label, '')), '{0}') or contains(lower(coalesce(title, '')), '{0}') or contains(lower(coalesce(alias, '')), '{0}')"


@query("search_nodes", f"select id, depth, display_label, count(*) over () as total from eff where not is_deleted and status = 'ok' and ({SEARCHED.format('title, \"1')}) order by depth, id limit 100", "eff")
def _(t):
    return B.search(t.effective, 'Title, "1', status="ok").select("id", "depth", "display_label", "total")


@query(
    "search_regex",
    "select id, url from eff where not is_deleted and (regexp_matches(url, '(?i)moved/[0-9]*7$') or regexp_matches(display_label, '(?i)moved/[0-9]*7$') or regexp_matches(coalesce(title, ''), '(?i)moved/[0-9]*7$') or regexp_matches(coalesce(alias, ''), '(?i)moved/[0-9]*7$')) order by depth, id limit 500",
    "eff",
)
def _(t):
    return B.search(t.effective, "MOVED/[0-9]*7$", regex=True, limit=500).select("id", "url")


@query("materials_filter", "select id, node_id, kind, rel_path from materials where site_id = 's1' and kind = 'html' order by id limit 300", "materials")
def _(t):
    return B.materials_list(t.materials, "s1", kind="html", limit=300).select("id", "node_id", "kind", "rel_path")


@query(
    "node_detail",
    """, labels as (select id, display_label from eff),
 i as (select to_id as node_id, 'in' as part, e.id as pos_key, e.from_id || '|' || l.display_label as item, row_number() over (partition by to_id order by e.id) as rn
   from edges e join labels l on l.id = e.from_id),
 o as (select from_id as node_id, 'out' as part, e.id as pos_key, e.to_id || '|' || l.display_label as item, row_number() over (partition by from_id order by order_in_page, e.id) as rn
   from edges e join labels l on l.id = e.to_id),
 h as (select node_id, 'override' as part, id as pos_key, concat_ws('|', field, value) as item, row_number() over (partition by node_id order by seq desc, id desc) as rn from overrides)
 select node_id, part, pos_key, item from i where rn <= 200 union all select node_id, part, pos_key, item from o where rn <= 500
 union all select node_id, 'material', id, kind || '|' || rel_path from materials union all select node_id, part, pos_key, item from h where rn <= 50""",
    "eff", "edges", "materials",
)
def _(t):
    return B.node_detail(t.effective, t.edges, t.overrides, t.materials)


@query(
    "recent_rows",
    """, r as (select *, row_number() over (partition by task_id order by id desc) as rn from fetch_logs) select task_id, id, http_status from r where rn <= 20""",
    "fetch_logs",
)
def _(t):
    return B.latest_n(t.fetch_logs, ["task_id"], ["-id"], 20).select("task_id", "id", "http_status")


@query("deepest_nodes", "select id, depth from nodes order by depth desc, id limit 10", "nodes")
def _(t):
    return B.deepest(t.nodes).select("id", "depth")


PAGE_SITES = "select cast(page_id as string) as id, url as root_url, page_id % 5 = 0 as archived, page_id % 40 as updated_at from {0}"


@query("site_list", f", s as ({PAGE_SITES.format('pages')}) select id, root_url, updated_at from s where not archived")
def _(t):
    return B.list_sites(t.sql(PAGE_SITES.format("{pages}"))).select("id", "root_url", "updated_at")


@query(
    "duplicate_root",
    f", s as ({PAGE_SITES.format('pages')}), " + duck_norm("x", "s", "root_url")
    + " select id from x where archived and exists (select 1 from x y where not y.archived and y.ident = x.ident)",
)
def _(t):
    keyed = normalize_url(t.sql(PAGE_SITES.format("{pages}")), "root_url", "n").withColumn("identity_key", F.col("n.identity_key"))
    return B.existing_roots(keyed.filter("archived"), keyed).select("id")


@query("root_node", "select site_id, arg_min(id, (depth, first_seen_at, id)) as id from nodes where auto_parent_id is null and not is_deleted group by 1", "nodes")
def _(t):
    return B.roots(t.nodes)


@query("tree_links", "select e.effective_parent_id as from_id, e.id as to_id from eff e where e.effective_parent_id in (select id from eff)", "eff")
def _(t):
    return B.tree_links(t.effective)


@query(
    "indent_order",
    """, topo as (select id, effective_parent_id as pid, display_label || '' as label from eff where not is_deleted),
 base as (select a.id, b.id as pid, a.label, row_number() over (partition by b.id order by a.label desc, a.id desc) = 1 as is_last from topo a left join topo b on b.id = a.pid),
 walk as (select id, label, is_last, 0 as level, label || chr(1) || id as path from base where pid is null
   union all select b.id, b.label, b.is_last, w.level + 1, w.path || chr(2) || b.label || chr(1) || b.id from base b join walk w on b.pid = w.id)
 select id, label, level, is_last, row_number() over (order by path) as line from walk""",
    "eff",
)
def _(t):
    topo = t.effective.filter(~F.col("is_deleted")).select(
        "id", F.col("effective_parent_id").alias("parent_id"), F.col("display_label").alias("label")
    )
    return B.indent_order(topo).drop("loop")


# ---- statistics ---------------------------------------------------------------


@query(
    "site_cards",
    """select s.id as site_id, count(*) filter (where not n.is_deleted) as node_count, count(*) filter (where not n.is_deleted and n.status = 'ok') as ok_count,
      count(*) filter (where not n.is_deleted and n.status = 'error') as error_count, coalesce(max(n.depth) filter (where not n.is_deleted), 0) as max_depth,
      max(n.last_fetch_at) as last_fetch_at, (select r.status from nodes r where r.site_id = s.id and r.auto_parent_id is null and not r.is_deleted order by r.depth, r.first_seen_at limit 1) as root_status
    from sites s join nodes n on n.site_id = s.id group by s.id""",
    "sites", "nodes",
)
def _(t):
    return S.site_cards(t.sites, t.nodes)


@query("status_distribution", "select site_id, status, count(*) as n from nodes where not is_deleted group by all", "nodes")
def _(t):
    return S.status_distribution(t.nodes)


@query("depth_distribution", "select site_id, depth, count(*) as n from nodes where not is_deleted group by all", "nodes")
def _(t):
    return S.depth_distribution(t.nodes)


@query("task_summary", "select task_id, count(*) filter (where http_status < 400 and error is null) as ok, count(*) filter (where error is not null or http_status is null or http_status >= 400) as failed, count(*) as fetched from fetch_logs group by 1", "fetch_logs")
def _(t):
    return S.task_summary(t.fetch_logs)


@query("in_link_count", "select to_id as node_id, count(*) as in_link_count from edges group by 1", "edges")
def _(t):
    return S.in_link_count(t.edges)


@query("identity_audit", ", k as (select site_id, split_part(identity_key, '/n/', 1) || '/' || cast(length(identity_key) as string) || right(identity_key, 2) as identity_key from nodes) select site_id, identity_key, count(*) as copies from k group by all having count(*) > 1", "nodes")
def _(t):
    short = F.concat(F.substring_index("identity_key", "/n/", 1), F.lit("/"), F.length("identity_key"), F.expr("right(identity_key, 2)"))
    return S.identity_duplicates(t.nodes.select("site_id", short.alias("identity_key")))


@query("visit_counts", 'select site_id, identity_key, count(*) as visits, max("at") as last_at from fetch_logs group by all', "fetch_logs")
def _(t):
    return S.visit_counts(t.fetch_logs)


@query(
    "table_counts",
    """select s.site_id, (select count(*) from nodes n where n.site_id = s.site_id) as nodes_count, (select count(*) from edges n where n.site_id = s.site_id) as edges_count,
      (select count(*) from materials n where n.site_id = s.site_id) as materials_count from (select distinct site_id from nodes) s""",
    "nodes", "edges", "materials",
)
def _(t):
    return S.table_counts(t.nodes, t.edges, t.materials)


@query("children_counts", "select site_id, auto_parent_id as parent_id, count(*) as children from nodes where not is_deleted group by all", "nodes")
def _(t):
    return S.children_counts(t.nodes)


@query(
    "crawl_progress",
    """, q as (select task_id, min(site_id) as site_id, count(*) filter (where state = 'pending') as queue_length, count(*) filter (where state = 'skipped') as skipped from queue group by 1),
 l as (select task_id, count(*) as fetched, count(*) filter (where http_status < 400 and error is null) as ok from fetch_logs group by 1),
 d as (select site_id, count(*) as discovered from nodes where not is_deleted group by 1)
 select task_id, coalesce(fetched, 0) as fetched, coalesce(ok, 0) as ok, coalesce(fetched - ok, 0) as failed, coalesce(skipped, 0) as skipped,
   coalesce(discovered, 0) as discovered, coalesce(queue_length, 0) as queue_length from q full join l using (task_id) left join d using (site_id)""",
    "queue", "fetch_logs", "nodes",
)
def _(t):
    return S.crawl_progress(t.fetch_logs, t.queue, t.nodes)


# ---- corrections ---------------------------------------------------------------

STATE = "case when discarded then 'discarded' when undone then 'redoable' else 'applied' end"


@query("override_timeline", f"select site_id, op_group, seq, {STATE} as state from ops", "ops")
def _(t):
    return C.timeline(t.ops).select("site_id", "op_group", "seq", "state")


@query(
    "stack_tops",
    f", s as (select *, {STATE} as state from ops) select site_id, arg_max(op_group, seq) filter (where state = 'applied') as undo_top, arg_min(op_group, seq) filter (where state = 'redoable') as redo_top from s group by 1",
    "ops",
)
def _(t):
    return C.stack_tops(t.ops)


@query("op_chain", "select site_id, op_group, lag(op_group) over (partition by site_id order by seq, id) as prev_op_group from ops", "ops")
def _(t):
    return C.op_chain(t.ops).select("site_id", "op_group", "prev_op_group")


@query("op_summary", "select o.site_id, o.op_group, o.kind, o.seq, (select count(*) from overrides r where r.op_group = o.op_group) as row_count from ops o", "ops", "overrides")
def _(t):
    return C.op_summary(t.ops, t.overrides)


@query("stack_depths", f", s as (select *, {STATE} as state from ops) select site_id, count(*) filter (where state = 'applied') as undo_depth, count(*) filter (where state = 'redoable') as redo_depth from s group by 1", "ops")
def _(t):
    return C.stack_depths(t.ops)


@query("next_seq", "select site_id, max(seq) + 1 as next_seq from (select site_id, seq from overrides union all select site_id, seq from ops) group by 1", "overrides", "ops")
def _(t):
    return C.next_seq(t.overrides, t.ops)


@query(
    "revert_rows",
    """select distinct o.op_group, r.node_id from (select op_group, unnest(payload) as rid from ops where kind = 'reverted') o join overrides r on r.id = o.rid
    union select o.op_group, r.node_id from ops o join overrides r on r.op_group = o.op_group where o.kind <> 'reverted'""",
    "ops", "overrides",
)
def _(t):
    return C.op_nodes(t.ops, t.overrides)


def moves(d) -> str:
    c = "c_custkey"
    k = idiv(c, 4)
    return f"""select 's' || cast({c} % 4 as string) as site_id, {nid(c)} as node_id,
      case {c} % 6 when 0 then {nid(f'({c} * 13 + 8) % {d.n}')} when 1 then {nid(c)} when 2 then null when 3 then 'gone'
        when 4 then {nid(f'({k} * 7 + 1) * 4 + {c} % 4')} else {nid(f'{idiv(k, 7)} * 4 + {c} % 4')} end as new_parent_id
    from {d.t('customer')}"""



FIXTURES["moves"] = moves


@query(
    "validate_moves",
    """, effm as materialized (select id, site_id, effective_parent_id from eff),
 anc as (select id as node, effective_parent_id as ancestor from effm where effective_parent_id is not null
   union select a.node, e.effective_parent_id from anc a join effm e on e.id = a.ancestor where e.effective_parent_id is not null)
 select m.site_id, m.node_id, m.new_parent_id, n.effective_parent_id as prev_value,
   case when m.new_parent_id is not null and p.id is null then 'parent_not_found' when n.id is null then 'not_found'
     when m.new_parent_id = m.node_id then 'self'
     when exists (select 1 from anc where anc.node = m.new_parent_id and anc.ancestor = m.node_id) then 'descendant'
     when m.new_parent_id is not distinct from n.effective_parent_id then 'no_change' else 'ok' end as verdict
 from moves m left join effm n on n.id = m.node_id and n.site_id = m.site_id left join effm p on p.id = m.new_parent_id and p.site_id = m.site_id""",
    "eff", "moves",
)
def _(t):
    return C.validate_moves(t.effective, t.moves)


PICK = "cast(id as bigint) % 29 = 5"
POS = "cast(id as bigint) * 7919 % 100003"
SUB = """, effm as materialized (select id, site_id, effective_parent_id, base_deleted, is_deleted, display_label, depth from eff),
 anc as (select id as node, effective_parent_id as ancestor from effm where effective_parent_id is not null
   union select a.node, e.effective_parent_id from anc a join effm e on e.id = a.ancestor where e.effective_parent_id is not null)"""


@query(
    "delete_subtrees",
    SUB + f""", picked as (select id, {POS} as pos from effm where {PICK}),
 top as (select id from picked p where not exists (select 1 from anc join picked q on q.id = anc.ancestor where anc.node = p.id and q.pos < p.pos)),
 sub as (select id from top union select e.id from effm e join sub s on e.effective_parent_id = s.id where not e.base_deleted)
 select e.site_id, e.id as node_id, 'deleted' as field, '1' as value, cast(cast(e.is_deleted as int) as varchar) as prev_value from sub join effm e on e.id = sub.id""",
    "eff",
)
def _(t):
    eff = t.effective
    ids = eff.filter(PICK).select("id", F.expr(POS).alias("pos"))
    return C.delete_subtrees(eff, ids, "g-del", 1).select("site_id", "node_id", "field", "value", "prev_value")


TRASH = """, tr as (select o.node_id, o.op_group, o.seq, e.site_id, e.effective_parent_id, e.display_label from overrides o join effm e on e.id = o.node_id
   where o.field = 'deleted' and o.value = '1' and not o.undone),
 rootsx as (select * from tr where effective_parent_id is null or effective_parent_id not in (select node_id from tr))"""


@query("trash_roots", SUB + TRASH + " select site_id, node_id, op_group from rootsx", "eff")
def _(t):
    return C.trash_roots(t.effective, t.overrides).select("site_id", "node_id", "op_group")


LIVE_SUB = """ sub as (select id as root, id from seeds union select s.root, e.id from effm e join sub s on e.effective_parent_id = s.id where not e.base_deleted)"""


@query("trash_view", SUB + TRASH + ", seeds as (select distinct node_id as id from rootsx)," + LIVE_SUB + " select r.site_id, r.node_id, r.op_group, r.display_label, (select count(*) from sub where sub.root = r.node_id) as affected_nodes from rootsx r", "eff")
def _(t):
    return C.trash_view(t.effective, t.overrides).select("site_id", "node_id", "op_group", "display_label", "affected_nodes")


@query("delete_impact", SUB + f", seeds as (select id from effm where {PICK})," + LIVE_SUB + " select root as id, count(*) as affected_nodes from sub group by 1", "eff")
def _(t):
    eff = t.effective
    return C.delete_impact(eff, eff.filter(PICK).select("id"))


# ---- walks ------------------------------------------------------------------------


@query("subtree", ", effm as materialized (select id, effective_parent_id, depth from eff), sub as (select id as root, id from effm where depth = 1 union select s.root, e.id from effm e join sub s on e.effective_parent_id = s.id) select root, id from sub", "eff")
def _(t):
    eff = t.effective
    return G.subtree(eff, eff.filter("depth = 1").select("id"))


@query("subtree_depth", ", effm as materialized (select id, effective_parent_id, depth from eff), sub as (select id as root, id, 0 as level from effm where depth = 0 union all select s.root, e.id, s.level + 1 from effm e join sub s on e.effective_parent_id = s.id) select root, id, level from sub", "eff")
def _(t):
    eff = t.effective
    return G.subtree(eff, eff.filter("depth = 0").select("id"), with_level=True)


@query("ancestors", ", effm as materialized (select id, effective_parent_id from eff), anc as (select id as node, effective_parent_id as ancestor, 1 as distance from effm where effective_parent_id is not null union all select a.node, e.effective_parent_id, a.distance + 1 from anc a join effm e on e.id = a.ancestor where e.effective_parent_id is not null) select * from anc", "eff")
def _(t):
    return G.ancestors(t.effective)


# ---- layouts ------------------------------------------------------------------------


@query(
    "layered_layout",
    """, r as (select site_id, id, depth, row_number() over (partition by site_id, depth order by coalesce(effective_parent_id, ''), id) - 1 as i from eff)
 select site_id, id, 24 + i * 182 as x, 24 + depth * 56 as y from r""",
    "eff",
)
def _(t):
    nodes = t.effective.select("site_id", "id", F.col("effective_parent_id").alias("parent_id"), "depth")
    return L.layered_layout(nodes).select("site_id", "id", "x", "y")


@query(
    "layered_size",
    ", c as (select site_id, depth, count(*) as n from nodes group by all) select site_id, 48 + max(n) * 182 as width, 48 + count(*) * 56 as height from c group by 1",
    "nodes",
)
def _(t):
    return L.layered_size(t.nodes)


@query(
    "radial_layout",
    """, r as (select site_id, id, depth, row_number() over (partition by site_id, depth order by id) - 1 as i, count(*) over (partition by site_id, depth) as n from nodes)
 select site_id, id, cast(round(1000 * (case when depth = 0 then 450 else 450 + least(410, depth * 130) * cos(i / n * 2 * pi()) end)) as bigint) as x_milli,
   cast(round(1000 * (case when depth = 0 then 450 else 450 + least(410, depth * 130) * sin(i / n * 2 * pi()) end)) as bigint) as y_milli from r""",
    "nodes",
)
def _(t):
    out = L.radial_layout(t.nodes.select("site_id", "id", "depth"))
    milli = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_milli")
    return out.select("site_id", "id", milli("x"), milli("y"))
