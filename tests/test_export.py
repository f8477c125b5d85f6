"""Export of port → {pier, cranes → {steel, rust → bolt}}."""

import csv
import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom.operators import export as X
from linkloom.plans.stage import new_path
from linkloom.schemas import schema

PARENTS = {"port": None, "pier": "port", "cranes": "port", "steel": "cranes", "rust": "cranes", "bolt": "rust"}


@pytest.fixture(scope="module")
def tables(spark):
    depth = lambda n: 0 if PARENTS[n] is None else 1 + depth(PARENTS[n])
    nodes = spark.createDataFrame(
        [(n, "s", f"https://x/{n}", f"https://x/{n}", None, n, None, 200, "text/html", depth(n), p, "ok", None, 1, 1, False, 5, None) for n, p in PARENTS.items()],
        schema("nodes"),
    )
    edges = spark.createDataFrame(
        [
            (11, "s", "port", "pier", "the pier", None, None, None, "_top", False, None, "auto", 0, 9),
            (12, "s", "port", "cranes", "tall; \"red\", new\rand wide", None, None, "ugc nofollow", None, True, "view", "auto", 1, 9),
            (13, "s", "cranes", "rust", "=1+1", None, None, None, None, False, None, "redirect", 0, 9),
            (14, "s", "rust", "bolt", None, None, None, None, None, False, None, "manual", 0, 9),
            (15, "s", "bolt", "pier", "", None, None, None, None, False, None, "auto", 0, 9),
        ],
        schema("edges"),
    )
    materials = spark.createDataFrame([(21, "s", "bolt", "screenshot", "raw/bolt.png", 99, "c1", 1), (22, "s", "bolt", "body", "parsed/bolt.json", 7, "c2", 1), (23, "s", "pier", "html", "raw/pier.html", 5, "c3", 1)], schema("materials"))
    sites = spark.createDataFrame([("s", "Site", "https://x/", "x", "same_site", None, 1, 2, False, None)], schema("sites"))
    return sites, nodes, edges, materials


def overrides(spark, rows=()):
    return spark.createDataFrame([(i + 1, "s", n, f, v, None, "g", i + 1, False, 0) for i, (n, f, v) in enumerate(rows)], schema("overrides"))


def dataset(spark, tables, rows=(), **kw):
    sites, nodes, edges, materials = tables
    return X.export_dataset(sites, nodes, edges, overrides(spark, rows), materials, generated_at=7, **kw)


def counts(ds):
    r = X.export_counts(ds).first()
    return r.nodes, r.edges, r.materials, r.deleted


def test_counts(spark, tables):
    assert counts(dataset(spark, tables)) == (6, 5, 3, 0)
    gone = [("rust", "deleted", "1"), ("bolt", "deleted", "1")]
    assert counts(dataset(spark, tables, gone)) == (4, 2, 1, 2)
    assert counts(dataset(spark, tables, gone, include_deleted=True)) == (6, 5, 3, 2)
    part = spark.createDataFrame([("rust",)], "id string")
    assert counts(dataset(spark, tables, subtree_of=part)) == (2, 1, 2, 0)
    moved = dataset(spark, tables, [("bolt", "parent", "steel")])
    assert {r.id: r.parent_id for r in moved.nodes.collect()}["bolt"] == "steel"


def test_csv_round_trip(spark, tables):
    path = new_path(spark, "test-csv")
    X.write_csv(X.edges_csv(dataset(spark, tables)).coalesce(1), path)
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(path.removeprefix("file:") + "/part-*")))
    header, *rows = csv.reader(text.splitlines(keepends=True))
    assert header == list(X.EDGE_COLUMNS) and text.count("\r\n") == 6
    by_id = {r[0]: dict(zip(header, r, strict=True)) for r in rows}
    assert by_id["12"]["anchor_text"].startswith('tall; "red", new') and by_id["12"]["is_nofollow"] == "true"
    assert by_id["14"]["anchor_text"] == "" and by_id["13"]["source"] == "redirect" and by_id["11"]["is_nofollow"] == "false"


def test_jsonl(spark, tables):
    lines = [r.line for r in X.nodes_jsonl(dataset(spark, tables)).orderBy("part", "ord_depth", "ord_id").collect()]
    meta, *nodes = map(json.loads, lines)
    assert meta["meta"]["counts"] == {"nodes": 6, "edges": 5, "materials": 3, "deleted": 0}
    assert [n["id"] for n in nodes] == ["port", "cranes", "pier", "rust", "steel", "bolt"]
    assert all(list(n) == list(X.NODE_COLUMNS) for n in nodes) and nodes[1]["alias"] is None
    assert sorted(m["kind"] for m in nodes[5]["materials"]) == ["body", "screenshot"] and nodes[0]["materials"] == []


def test_nodes_csv_joins_materials(spark, tables):
    ends = [r.line.rstrip().rsplit(",", 1)[-1] for r in X.nodes_csv(dataset(spark, tables)).collect()]
    assert "parsed/bolt.json raw/bolt.png" in ends and "raw/pier.html" in ends


def test_mermaid(spark, tables):
    named = [("cranes", "alias", "{big} [old] 'x'")]
    lines = [r.line for r in X.mermaid(dataset(spark, tables, named), 4).orderBy("part", "pos").collect()]
    assert lines[0] == "flowchart TD" and lines[-1].startswith("  truncated[") and "2 more" in lines[-1]
    drawn = [x for x in lines if "big" in x]
    assert len(drawn) == 1 and not set("{}") & set(drawn[0]) and drawn[0].startswith("  n2[")
    assert "  n1 --> n2" in lines and "  n1 --> n3" in lines and not any("n5" in x for x in lines)


def test_manifest_matches_files(spark, tables):
    path = new_path(spark, "test-export")
    ds = dataset(spark, tables)
    X.write_graph_json(ds, f"{path}/graph")
    X.export_materials(ds).write.json(f"{path}/materials")
    listed = {r.name: r for r in X.export_manifest(spark, path).collect()}
    root = path.removeprefix("file:")
    on_disk = [f for f in glob.glob(root + "/**/part-*", recursive=True)if os.path.isfile(f)]
    assert len(listed) == len(on_disk)
    for f in on_disk:
        name = os.path.relpath(f, root)
        data = open(f, "rb").read()
        assert listed[name].sha256 == hashlib.sha256(data).hexdigest() and listed[name].bytes == len(data)
    X.write_manifest(spark, path)
    again = {r.name for r in X.export_manifest(spark, path).filter(~F.col("name").startswith("_")).collect()}
    assert again == set(listed)


def test_archive(spark):
    pages = spark.createDataFrame([("s", "n", "https://x/", "<title>Keel</title><body>oak æ" + " plank" * 2000 + "</body>")], "site_id string, node_id string, url string, html string")
    parsed, files = X.archive_pages(pages, store_raw=True)
    row = parsed.first()
    assert (row.title, row.text_excerpt, row.text_length) == ("Keel", "oak æ" + " plank" * 2000, 12_005)
    assert X.archive_pages(pages, excerpt_max=5)[0].first().text_excerpt == "oak æ"
    raw = pages.first().html.encode()
    html = files.filter("kind = 'html'").first()
    assert (html.bytes, html.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [r.kind for r in X.archive_pages(pages)[1].collect()] == ["body"]
