"""Explicit schemas of all tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "page_snapshot": """page_id long, site_id string, url string, final_url string, http_status int,
        content_type string, html string, redirect_chain array<string>, duration_ms long, fetch_seq long""",
    "sites": """id string, name string, root_url string, root_host string, scope string, allowlist array<string>,
        created_at long, updated_at long, archived boolean, note string""",
    "nodes": """id string, site_id string, identity_key string, url string, alias string, display_label string,
        title string, http_status int, content_type string, depth int, auto_parent_id string, status string,
        content_hash string, in_link_count long, out_link_count long, is_deleted boolean, first_seen_at long,
        last_fetch_at long""",
    "edges": """id long, site_id string, from_id string, to_id string, anchor_text string, selector string,
        dom_path string, rel string, target string, is_nofollow boolean, fragment string, source string,
        order_in_page int, created_at long""",
    "overrides": """id long, site_id string, node_id string, field string, value string, prev_value string,
        op_group string, seq long, undone boolean, created_at long""",
    "override_ops": """id long, site_id string, op_group string, kind string, seq long, prev_op_group string,
        payload array<long>, undone boolean, discarded boolean, created_at long""",
    "override_commands": """site_id string, seq long, ts timestamp, command string, op_group string, node_id string,
        field string, value string""",
    "materials": """id long, site_id string, node_id string, kind string, rel_path string, bytes long,
        sha256 string, created_at long""",
    "crawl_tasks": """id string, site_id string, preset_json string, status string, stats_json string,
        started_at long, finished_at long""",
    "crawl_queue": """id long, task_id string, site_id string, node_id string, depth int, priority int,
        state string, attempts int, next_retry_at long""",
    "fetch_logs": """id long, task_id string, node_id string, url string, http_status int, duration_ms long,
        error string, redirect_chain array<string>, at long""",
    "access_counts": "site_id string, identity_key string, visits long, last_at long",
    "manual_overrides": """id string, site_id string, session_id string, node_id string, kind string, value string,
        created_at long""",
    "exports": """id string, site_id string, format string, scope_json string, dir string, status string,
        manifest_path string, site_name string, root_url string, preset_id string, counts_json string,
        error string, created_at long, finished_at long""",
    "robots_rules": "origin string, allow boolean, path string, weight int, crawl_delay_ms long",
    "clicks": """session_id string, ts timestamp, tag string, href string, target string, ctrl boolean, meta boolean,
        shift boolean, from_node string, from_depth int""",
    "navigations": "session_id string, ts timestamp, url string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


