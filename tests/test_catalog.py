"""A sample of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from linkloom.catalog import ORACLES, QUERIES
from linkloom.catalog.check import TABLES, canonical

SAMPLE = (
    "host_link_targets robots_allowed effective_nodes children_page indent_order site_cards validate_moves edge_dedup "
    "visit_limit frontier_pick export_nodes_jsonl export_edges_csv progress_stream override_replay"
).split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, small, name):
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck.sql(ORACLES[name]).df())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_html_is_not_read_when_unused(spark, small):
    from linkloom.catalog.base import Tables
    from linkloom.functions.urls import normalize_url

    plan = normalize_url(Tables(spark, small).pages, "url", "n").select("n.identity_key")._jdf.queryExecution().toString()
    scan = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert scan and all("html" not in x.split("ReadSchema")[1] for x in scan)
