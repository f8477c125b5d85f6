"""Exports: effective nodes, trimmed edges, materials, in several formats.

Formats are DataFrames of text lines with an explicit order, written in
parallel; nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import content_fingerprint, extract_content
from ..options import SCHEMA_VERSION
from ..plans.ordered import first_n, with_row_number
from ..plans.pin import pinned
from .effective import effective_nodes
from .graph import subtree, trim_edges

# ---- fixed values: export columns in order ------------------------------
EDGE_COLUMNS = (
    "id", "from_id", "to_id", "anchor_text", "selector", "dom_path", "rel", "target", "is_nofollow", "fragment",
    "source", "order_in_page", "created_at",
)
NODE_COLUMNS = (
    "id", "identity_key", "url", "alias", "display_label", "title", "http_status", "content_type", "depth",
    "parent_id", "auto_parent_id", "status", "content_hash", "in_link_count", "out_link_count", "is_deleted",
    "has_override", "first_seen_at", "last_fetch_at", "materials",
)
MERMAID_MAX_NODES = 800
MERMAID_LABEL_MAX = 60
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """A lazily evaluated export of one or more sites."""

    sites: DataFrame
    nodes: DataFrame
    edges: DataFrame
    materials: DataFrame
    deleted: DataFrame
    generated_at: int


def attach_materials(nodes: DataFrame, materials: DataFrame) -> DataFrame:
    """Add ``materials``: array of (kind, rel_path, bytes, sha256) in kind, id order."""
    item = F.struct("kind", "id", "rel_path", "bytes", "sha256")
    packed = materials.groupBy(F.col("node_id").alias("_m")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    shaped = F.transform("_items", lambda m: F.struct(m["kind"].alias("kind"), m["rel_path"].alias("rel_path"), m["bytes"].alias("bytes"), m["sha256"].alias("sha256")))
    empty = F.array().cast("array<struct<kind:string,rel_path:string,bytes:bigint,sha256:string>>")
    return nodes.join(packed, nodes["id"] == packed["_m"], "left").select(
        *[nodes[c] for c in nodes.columns], F.coalesce(shaped, empty).alias("materials")
    )


def export_dataset(
    sites: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    overrides: DataFrame,
    materials: DataFrame,
    *,
    subtree_of: DataFrame | None = None,
    include_deleted: bool = False,
    generated_at: int = 0,
) -> Dataset:
    """Effective nodes of whole sites or of the subtrees of ``subtree_of`` (id).

    Deleted nodes are left out unless asked for, but always counted.
    """
    effective = effective_nodes(nodes, overrides)
    deleted = effective.filter(F.col("is_deleted")).groupBy("site_id").agg(F.count("*").alias("deleted"))
    kept = effective if include_deleted else effective.filter(~F.col("is_deleted"))
    if subtree_of is not None:
        members = subtree(effective, subtree_of).select("id").distinct()
        kept = kept.join(members, "id", "left_semi")
    kept = kept.withColumnRenamed("effective_parent_id", "parent_id").drop("base_deleted")
    ids = kept.select("id")
    return Dataset(
        sites=sites,
        nodes=attach_materials(kept, materials),
        edges=trim_edges(edges, ids),
        materials=materials.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi"),
        deleted=deleted,
        generated_at=generated_at,
    )


def export_counts(ds: Dataset) -> DataFrame:
    """nodes, edges, materials and deleted per site."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("site_id").agg(F.count("*").alias(name))

    out = ds.sites.select(F.col("id").alias("site_id"))
    for part in (counted(ds.nodes, "nodes"), counted(ds.edges, "edges"), counted(ds.materials, "materials"), ds.deleted):
        out = out.join(part, "site_id", "left")
    return out.fillna(0, ["nodes", "edges", "materials", "deleted"])


# ---- text formats -------------------------------------------------------


def csv_field(c: Column) -> Column:
    """RFC 4180 field: quoted only when needed, NULL empty."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def _csv(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Header and one line per row; ``ord`` columns sort the file (header first)."""
    spark = rows.sparkSession
    line = F.array_join(F.array(*[csv_field(F.col(c)) for c in columns]), ",")
    body = rows.select("site_id", F.lit(1).alias("part"), *[F.col(o).alias(f"ord_{o}") for o in order], line.alias("line"))
    header = spark.range(1).select(
        F.lit(None).cast("string").alias("site_id"),
        F.lit(0).alias("part"),
        *[F.lit(None).cast(rows.schema[o].dataType).alias(f"ord_{o}") for o in order],
        F.lit(",".join(columns)).alias("line"),
    )
    return header.unionByName(body)


def edges_csv(ds: Dataset) -> DataFrame:
    return _csv(ds.edges, EDGE_COLUMNS, ["id"])


def nodes_csv(ds: Dataset) -> DataFrame:
    flat = ds.nodes.withColumn("materials", F.array_join(F.transform("materials", lambda m: m["rel_path"]), " "))
    return _csv(flat, NODE_COLUMNS, ["depth", "id"])


def write_csv(lines: DataFrame, path: str) -> None:
    """CRLF text in order.  A range sort keeps the write parallel."""
    order = [c for c in lines.columns if c.startswith("ord_")]
    lines.orderBy("part", *order).select("line").write.option("lineSep", "\r\n").text(path)


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def nodes_jsonl(ds: Dataset) -> DataFrame:
    """Per site a meta line, then one JSON object per node, in depth, id order."""
    counts = export_counts(ds)
    meta = ds.sites.join(counts, ds.sites["id"] == counts["site_id"]).select(
        F.col("site_id"),
        F.lit(0).alias("part"),
        F.lit(None).cast("int").alias("ord_depth"),
        F.lit(None).cast("string").alias("ord_id"),
        _json(
            F.struct(
                F.struct(
                    F.lit(SCHEMA_VERSION).alias("schemaVersion"),
                    F.col("site_id").alias("siteId"),
                    F.col("root_url").alias("rootUrl"),
                    F.lit(ds.generated_at).alias("generatedAt"),
                    F.struct("nodes", "edges", "materials", "deleted").alias("counts"),
                ).alias("meta")
            )
        ).alias("line"),
    )
    body = ds.nodes.select(
        "site_id",
        F.lit(1).alias("part"),
        F.col("depth").alias("ord_depth"),
        F.col("id").alias("ord_id"),
        _json(F.struct(*NODE_COLUMNS)).alias("line"),
    )
    return meta.unionByName(body)


def write_jsonl(lines: DataFrame, path: str) -> None:
    lines.orderBy("site_id", "part", "ord_depth", "ord_id").select("line").write.text(path)


def export_materials(ds: Dataset) -> DataFrame:
    """Flat list of the exported nodes' files."""
    urls = ds.nodes.select(F.col("id").alias("_n"), "url")
    return ds.materials.join(urls, ds.materials["node_id"] == urls["_n"]).select(
        "site_id", "node_id", "url", "kind", "rel_path", "bytes", "sha256"
    )


def graph_json(ds: Dataset) -> DataFrame:
    """(part, line): meta, node and edge objects; one dataset, written in parallel."""
    scope = F.struct(F.lit("effective").alias("projection"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(ds.generated_at).alias("generatedAt"))
    meta = ds.sites.select(F.col("id").alias("site_id"), F.lit("meta").alias("part"), _json(F.struct(F.col("id").alias("siteId"), F.col("name").alias("siteName"), F.col("root_url").alias("rootUrl"), scope.alias("meta"))).alias("line"))
    nodes = ds.nodes.select("site_id", F.lit("nodes").alias("part"), _json(F.struct(*NODE_COLUMNS)).alias("line"))
    edges = ds.edges.select("site_id", F.lit("edges").alias("part"), _json(F.struct(*EDGE_COLUMNS)).alias("line"))
    return meta.unionByName(nodes).unionByName(edges)


def write_graph_json(ds: Dataset, path: str) -> None:
    graph_json(ds).select("part", "line").write.partitionBy("part").text(path)


def mermaid(ds: Dataset, max_nodes: int = MERMAID_MAX_NODES) -> DataFrame:
    """Flowchart lines per site (site_id, part, pos, line): top nodes by (depth, id)."""
    kept = with_row_number(first_n(ds.nodes, ["site_id"], ["depth", "id"], max_nodes), ["site_id"], ["depth", "id"], "n")
    text = F.coalesce("display_label", "alias", "title", "url")
    label = F.substring(F.regexp_replace(F.replace(text, F.lit('"'), F.lit("'")), r"[\[\]{}()]", " "), 1, MERMAID_LABEL_MAX)
    kept = kept.select("site_id", "id", "parent_id", "n", label.alias("label"))
    head = kept.select("site_id").distinct().select(
        "site_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit("flowchart TD").alias("line")
    )
    boxes = kept.select(
        "site_id",
        F.lit(1).alias("part"),
        F.col("n").alias("pos"),
        F.concat(F.lit("  n"), F.col("n").cast("string"), F.lit('["'), F.col("label"), F.lit('"]')).alias("line"),
    )
    up = kept.select(F.col("id").alias("_up"), F.col("n").alias("_pn"))
    arrows = kept.join(up, kept["parent_id"] == up["_up"]).select(
        "site_id",
        F.lit(2).alias("part"),
        F.col("n").alias("pos"),
        F.concat(F.lit("  n"), F.col("_pn").cast("string"), F.lit(" --> n"), F.col("n").cast("string")).alias("line"),
    )
    totals = ds.nodes.groupBy("site_id").agg(F.count("*").alias("_t")).filter(F.col("_t") > max_nodes)
    rest = totals.select(
        "site_id",
        F.lit(3).alias("part"),
        F.lit(0).alias("pos"),
        F.concat(
            F.lit('  truncated["… '), (F.col("_t") - max_nodes).cast("string"), F.lit(f' more nodes not drawn (limit {max_nodes})"]')
        ).alias("line"),
    )
    return head.unionByName(boxes).unionByName(arrows).unionByName(rest)


def snapshot_tables(ds: Dataset) -> dict[str, DataFrame]:
    meta = ds.sites.select(
        F.col("id").alias("site_id"), "name", "root_url", "scope", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ds.generated_at).alias("generated_at")
    )
    return {"nodes": ds.nodes, "edges": ds.edges, "materials": ds.materials, "meta": meta, "counts": export_counts(ds)}


def write_snapshot(ds: Dataset, path: str) -> None:
    """Queryable snapshot: one Parquet table per part below ``path``."""
    for name, df in snapshot_tables(ds).items():
        df.write.parquet(f"{path}/{name}")


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, dataset, layer, bytes and sha256 of every file below an export path.

    Read after all other files are written; the manifest does not list itself.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "part-*")
        .load(path)
    )
    rel = F.regexp_extract("path", r"([^/]+/(?:part=[^/]+/)?part-[^/]+)$", 1)
    dataset = F.regexp_extract(F.col("name"), "^([^/]+)/", 1)
    return files.select(rel.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).select(
        "name", dataset.alias("dataset"), F.when(dataset == "materials", "raw").otherwise("structure").alias("layer"), "bytes", "sha256"
    )


def write_manifest(spark: SparkSession, path: str) -> None:
    export_manifest(spark, path).write.json(f"{path}/_manifest")


# ---- page archive -------------------------------------------------------


def archive_pages(pages: DataFrame, store_raw: bool = False, excerpt_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed record per page and its material rows.

    Input: site_id, node_id, url, html.  ``store_raw`` adds the html row; the text is
    cut only where ``excerpt_max`` is given.
    """
    raw_rel = F.concat(F.lit("raw/"), F.col("node_id"), F.lit(".html"))
    parsed = extract_content(pages)
    parsed = pinned(parsed.withColumn("content_hash", content_fingerprint(F.col("text"))), "content_hash")
    record = parsed.select(
        "site_id",
        "node_id",
        "url",
        "title",
        "description",
        "text_length",
        "content_hash",
        (F.col("text") if excerpt_max is None else F.substring("text", 1, excerpt_max)).alias("text_excerpt"),
        (raw_rel if store_raw else F.lit(None).cast("string")).alias("raw_rel_path"),
        (F.sha2("html", 256) if store_raw else F.lit(None).cast("string")).alias("raw_sha256"),
    )
    body_json = _json(F.struct(*record.columns))
    body = record.select(
        "site_id",
        "node_id",
        F.lit("body").alias("kind"),
        F.concat(F.lit("parsed/"), F.col("node_id"), F.lit(".json")).alias("rel_path"),
        F.octet_length(body_json).cast("long").alias("bytes"),
        F.sha2(body_json, 256).alias("sha256"),
    )
    if not store_raw:
        return record, body
    raw = pages.select(
        "site_id",
        "node_id",
        F.lit("html").alias("kind"),
        raw_rel.alias("rel_path"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha2("html", 256).alias("sha256"),
    )
    return record, raw.unionByName(body)
