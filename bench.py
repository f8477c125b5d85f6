"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from linkloom.catalog import QUERIES

HEADLINE = (
    "url_normalize extract_links extract_content content_fingerprint host_link_targets robots_allowed detect_pagination "
    "effective_nodes latest_override children_page search_nodes node_detail site_cards status_distribution "
    "edge_dedup first_parent link_to_node trim_edges content_dedup visit_limit prefix_prune pagination_limit "
    "host_schedule frontier_pick subtree ancestors validate_moves indent_order layered_layout "
    "export_nodes_jsonl export_edges_csv export_mermaid override_replay click_pairing visit_stream crawl_pages"
).split()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{directory}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
