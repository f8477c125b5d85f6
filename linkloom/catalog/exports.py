"""Export queries: datasets, text formats, snapshots, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as X
from ..plans.stage import new_path
from .base import query

GENERATED = 1_700_000_000_000


def dataset(t, **kwargs) -> X.Dataset:
    return X.export_dataset(t.sites, t.nodes, t.edges, t.overrides, t.materials, generated_at=GENERATED, **kwargs)


KEPT = """, kept as materialized (select * from eff where not is_deleted),
 ke as materialized (select * from edges where from_id in (select id from kept) and to_id in (select id from kept)),
 km as materialized (select * from materials where node_id in (select id from kept))"""


def csv(expr: str) -> str:
    e = f"cast({expr} as varchar)"
    return f"""case when {e} is null then '' when regexp_matches({e}, '[",\\r\\n]') then '"' || replace({e}, '"', '""') || '"' else {e} end"""


NODE_SQL = {"parent_id": "effective_parent_id", "materials": "(select string_agg(rel_path, ' ' order by kind, id) from km where km.node_id = kept.id)"}
MATERIAL_LIST = """coalesce((select list({'kind': kind, 'rel_path': rel_path, 'bytes': bytes, 'sha256': sha256} order by kind, km.id) from km where km.node_id = kept.id), [])"""


@query("export_dataset", KEPT + " select id, site_id, url, depth, effective_parent_id as parent_id, has_override, (select count(*) from km where km.node_id = kept.id) as files from kept", "eff", "edges", "materials")
def _(t):
    return dataset(t).nodes.select("id", "site_id", "url", "depth", "parent_id", "has_override", F.size("materials").alias("files"))


@query(
    "export_subtree",
    """, effm as materialized (select * from eff), sub as (select id from effm where depth = 1 and id % 3 = 0 union select e.id from effm e join sub s on e.effective_parent_id = s.id)
 select id, is_deleted from effm where id in (select id from sub)""".replace("id % 3 = 0", "cast(id as bigint) % 3 = 0"),
    "eff",
)
def _(t):
    roots = t.nodes.filter("depth = 1 and cast(id as bigint) % 3 = 0").select("id")
    return dataset(t, subtree_of=roots, include_deleted=True).nodes.select("id", "is_deleted")


@query(
    "attach_materials",
    "select n.id, (select string_agg(kind || ':' || rel_path || ':' || bytes, ' ' order by kind, m.id) from materials m where m.node_id = n.id) as files from nodes n",
    "nodes", "materials",
)
def _(t):
    out = X.attach_materials(t.nodes.select("id"), t.materials)
    text = F.array_join(F.transform("materials", lambda m: F.concat_ws(":", m["kind"], m["rel_path"], m["bytes"].cast("string"))), " ")
    return out.select("id", F.nullif(text, F.lit("")).alias("files"))


@query(
    "export_counts",
    KEPT + """ select s.id as site_id, (select count(*) from kept where site_id = s.id) as nodes, (select count(*) from ke where site_id = s.id) as edges,
   (select count(*) from km where site_id = s.id) as materials, (select count(*) from eff where is_deleted and site_id = s.id) as deleted from sites s""",
    "eff", "edges", "materials", "sites",
)
def _(t):
    return X.export_counts(dataset(t))


EDGE_LINE = " || ',' || ".join(csv(c) for c in X.EDGE_COLUMNS)
NODE_LINE = " || ',' || ".join(csv(NODE_SQL.get(c, c)) for c in X.NODE_COLUMNS)


@query("export_edges_csv", KEPT + f" select 0 as part, '{','.join(X.EDGE_COLUMNS)}' as line union all select 1, {EDGE_LINE} from ke", "eff", "edges", "materials")
def _(t):
    return X.edges_csv(dataset(t)).select("part", "line")


@query("export_nodes_csv", KEPT + f" select 0 as part, '{','.join(X.NODE_COLUMNS)}' as line union all select 1, {NODE_LINE} from kept", "eff", "edges", "materials")
def _(t):
    return X.nodes_csv(dataset(t)).select("part", "line")


def _struct(columns, special) -> str:
    return "{" + ", ".join(f"'{c}': {special.get(c, c)}" for c in columns) + "}"


NODE_JSON = f"cast(to_json({_struct(X.NODE_COLUMNS, {'parent_id': 'effective_parent_id', 'materials': MATERIAL_LIST})}) as varchar)"
EDGE_JSON = f"cast(to_json({_struct(X.EDGE_COLUMNS, {})}) as varchar)"


@query(
    "export_nodes_jsonl",
    KEPT + f""" select s.id as site_id, 0 as part, cast(to_json({{'meta': {{'schemaVersion': '1.0', 'siteId': s.id, 'rootUrl': s.root_url, 'generatedAt': {GENERATED},
     'counts': {{'nodes': (select count(*) from kept where site_id = s.id), 'edges': (select count(*) from ke where site_id = s.id),
     'materials': (select count(*) from km where site_id = s.id), 'deleted': (select count(*) from eff where is_deleted and site_id = s.id)}}}}}}) as varchar) as line from sites s
   union all select site_id, 1, {NODE_JSON} from kept""",
    "eff", "edges", "materials", "sites",
)
def _(t):
    return X.nodes_jsonl(dataset(t)).select("site_id", "part", "line")


@query(
    "export_graph_json",
    KEPT + f""" select id as site_id, 'meta' as part, cast(to_json({{'siteId': id, 'siteName': name, 'rootUrl': root_url,
     'meta': {{'projection': 'effective', 'schemaVersion': '1.0', 'generatedAt': {GENERATED}}}}}) as varchar) as line from sites
   union all select site_id, 'nodes' as part, {NODE_JSON} as line from kept union all select site_id, 'edges', {EDGE_JSON} from ke""",
    "eff", "edges", "materials", "sites",
)
def _(t):
    return X.graph_json(dataset(t))


@query("export_materials", KEPT + " select km.site_id, node_id, kept.url, kind, rel_path, bytes, sha256 from km join kept on kept.id = km.node_id", "eff", "edges", "materials")
def _(t):
    return X.export_materials(dataset(t))


@query(
    "export_mermaid",
    KEPT + """, r as (select *, row_number() over (partition by site_id order by depth, id) as n, count(*) over (partition by site_id) as total from kept),
 top as (select * from r where n <= 200)
 select distinct site_id, 0 as part, 0 as pos, 'flowchart TD' as line from top
 union all select site_id, 1, n, '  n' || n || '["' || left(regexp_replace(replace(coalesce(display_label, alias, title, url), '"', ''''), '[\\[\\]{}()]', ' ', 'g'), 60) || '"]' from top
 union all select a.site_id, 2, a.n, '  n' || b.n || ' --> n' || a.n from top a join top b on b.id = a.effective_parent_id
 union all select distinct site_id, 3, 0, '  truncated["… ' || (total - 200) || ' more nodes not drawn (limit 200)"]' from r where total > 200""",
    "eff", "edges", "materials",
)
def _(t):
    return X.mermaid(dataset(t), max_nodes=200)


@query(
    "export_snapshot",
    KEPT + """ select 'nodes' as part, site_id, count(*) as n from kept group by all union all select 'edges', site_id, count(*) from ke group by all
   union all select 'materials', site_id, count(*) from km group by all union all select 'meta', id, 1 from sites union all select 'counts', id, 1 from sites""",
    "eff", "edges", "materials", "sites",
)
def _(t):
    path = new_path(t.spark, "snapshot")
    ds = dataset(t)
    X.write_snapshot(ds, path)
    parts = []
    for name in X.snapshot_tables(ds):
        df = t.spark.read.parquet(f"{path}/{name}")
        parts.append(df.groupBy("site_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "site_id", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("export_manifest")
def _(t):
    """Per dataset of a written export: listed files, and that every checksum is present."""
    path = new_path(t.spark, "export")
    ds = dataset(t)
    X.write_graph_json(ds, f"{path}/graph")
    X.write_csv(X.edges_csv(ds), f"{path}/edges")
    X.export_materials(ds).write.json(f"{path}/materials")
    X.write_manifest(t.spark, path)
    schema = "name string, dataset string, layer string, bytes long, sha256 string"
    manifest = t.spark.read.schema(schema).json(f"{path}/_manifest/part-*")
    return manifest.groupBy("dataset", "layer").agg(
        F.count_if(F.length("sha256") != 64).alias("without_checksum"), (F.sum("bytes") > 0).alias("has_bytes")
    )
