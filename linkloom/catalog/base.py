"""Registry, table access and the inputs derived from the given tables.

Derived inputs are row-wise SQL that both engines run on the same tables, so
they grow with them.  Node ``c`` is customer key ``c``: site ``c % 4``, number
``c div 4`` inside the site, parent number ``number div 7``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("customer", "orders", "events", "documents", "pages")
NOW = 1_700_000_500


def idiv(a: str, b: object) -> str:
    return f"cast(floor(({a}) / {b}) as bigint)"


def nid(c: str) -> str:
    return f"lpad(cast({c} as string), 12, '0')"


def site(c: str) -> str:
    return f"('s' || cast(({c}) % 4 as string))"


class SparkDialect:
    """Table names become parameters of ``spark.sql``; ``n`` is a literal."""

    def __init__(self, n: int) -> None:
        self.n = str(n)

    def t(self, name: str) -> str:
        return "{" + name + "}"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def q(self, name: str) -> str:
        return f"`{name}`"

    empty = "cast(array() as array<bigint>)"


class DuckDialect:
    n = "(select count(*) from customer)"

    def t(self, name: str) -> str:
        return name

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def q(self, name: str) -> str:
        return f'"{name}"'

    empty = "cast([] as bigint[])"


def _depth(k: str) -> str:
    cases = " ".join(f"when {k} < {7 ** i} then {i}" for i in range(1, 13))
    return f"case when {k} = 0 then 0 {cases} else 13 end"


def nodes(d) -> str:
    c = "c_custkey"
    k = idiv(c, 4)
    host = f"'https://' || {site(c)} || '.example.com/n/' || cast({c} as string)"
    status = "case c_nationkey % 4 when 0 then 'ok' when 1 then 'error' when 2 then 'skipped' else 'blocked' end"
    return f"""select {nid(c)} as id, {site(c)} as site_id, {host} as identity_key,
      {host} || case when {c} % 5 = 0 then '#top' else '' end as url,
      case when {c} % 11 = 3 then 'al ' || cast({c} as string) end as alias, c_name as display_label,
      case when {c} % 3 = 0 then null else 'T ' || c_name end as title,
      case c_nationkey % 4 when 0 then 200 when 1 then 500 when 2 then 200 end as http_status,
      'text/html' as content_type, cast({_depth(k)} as int) as depth,
      case when {k} = 0 then null else {nid(f"{idiv(k, 7)} * 4 + {c} % 4")} end as auto_parent_id, {status} as status,
      case when c_nationkey % 4 = 0 then md5(cast({c} % 50 as string)) end as content_hash,
      {c} % 13 as in_link_count, {c} % 7 as out_link_count, {c} % 37 = 36 as is_deleted,
      1700000000 + {c} as first_seen_at, case when {c} % 6 <> 0 then 1700000000 + {c} * 2 end as last_fetch_at
    from {d.t('customer')}"""


def overrides(d) -> str:
    e = "event_id"
    c = f"(4 + {e} % ({d.n} - 4))"
    up = nid(f"{idiv(idiv(c, 4), 11)} * 4 + {c} % 4")
    return f"""select {e} + 1 as id, {site(c)} as site_id, {nid(c)} as node_id,
      case event_type when 'signup' then 'parent' when 'view' then 'alias' when 'click' then 'title'
        when 'purchase' then 'url' else 'deleted' end as field,
      case event_type when 'signup' then {up}
        when 'view' then case when {e} % 13 = 0 then '' when {e} % 13 = 1 then null else 'alias ' || cast({e} as string) end
        when 'click' then 'title, "' || cast({e} as string) || '"'
        when 'purchase' then 'https://' || {site(c)} || '.example.com/moved/' || cast({e} as string)
        else '1' end as value,
      cast(null as string) as prev_value, 'g' || cast({idiv(e, 2)} as string) as op_group, {e} + 1 as seq,
      ({e} % 5 = 0) or (event_type = 'error' and {e} % 4 <> 0) as undone, 1700000000 + {e} as created_at
    from {d.t('events')}"""


def ops(d) -> str:
    e = "event_id"
    c = f"(4 + {e} % ({d.n} - 4))"
    return f"""select {e} + 1 as id, {site(c)} as site_id, 'g' || cast({e} as string) as op_group,
      case when {e} % 17 = 0 then 'reverted' else event_type end as kind, {e} + 1 as seq,
      case when {e} % 17 = 0 then {d.arr(f'{e} + 1', idiv(e, 2) + ' + 1')} else {d.empty} end as payload,
      {e} % 5 = 0 as undone, {e} % 15 = 0 as discarded, 1700000000 + {e} as created_at
    from {d.t('events')}"""


def edges(d) -> str:
    e = "event_id"
    f = f"({e} % {d.n})"
    to = f"((({e} * 31 + user_id) % {idiv(d.n, 4)}) * 4 + {e} % {d.n} % 4)"
    return f"""select {e} + 1 as id, {site(f)} as site_id, {nid(f)} as from_id, {nid(to)} as to_id,
      case when {e} % 6 = 0 then event_type || ', "' || cast({e} as string) || '"' else event_type end as anchor_text,
      cast(null as string) as selector, cast(null as string) as dom_path,
      case when {e} % 7 = 0 then 'nofollow' end as rel, case when {e} % 9 = 0 then '_blank' end as target,
      {e} % 7 = 0 as is_nofollow, case when {e} % 3 = 0 then 's' || cast({e} % 4 as string) end as fragment,
      case {e} % 10 when 9 then 'manual' when 8 then 'redirect' else 'auto' end as source,
      cast({idiv(e, d.n)} as int) as order_in_page, 1700000000 + {e} as created_at
    from {d.t('events')}"""


def materials(d) -> str:
    o = "o_orderkey"
    kind = f"case {o} % 4 when 0 then 'body' when 1 then 'html' when 2 then 'screenshot' else 'attachment' end"
    return f"""select {o} + 1 as id, {site('o_custkey')} as site_id, {nid('o_custkey')} as node_id, {kind} as kind,
      'raw/' || cast({o} % 3 as string) || '.' || {kind} as rel_path, {o} * 7 % 100000 as bytes,
      md5(cast({o} as string)) as sha256, 1700000000 + {o} as created_at
    from {d.t('orders')}"""


def sites(d) -> str:
    c = "c_custkey"
    return f"""select {site(c)} as id, 'Site ' || cast({c} as string) as name,
      'https://' || {site(c)} || '.example.com/n/' || cast({c} as string) as root_url,
      {site(c)} || '.example.com' as root_host, 'same_site' as scope, {c} = 3 as archived,
      1700000000 + {c} as updated_at
    from {d.t('customer')} where {c} < 4"""


def fetch_logs(d) -> str:
    e = "event_id"
    return f"""select {e} + 1 as id, 't' || cast(user_id % 20 as string) as task_id,
      {site('user_id')} as site_id, {nid(f'{e} % 997')} as node_id,
      'https://' || {site('user_id')} || '.example.com/n/' || cast({e} % 997 as string) as identity_key,
      case event_type when 'error' then 500 when 'signup' then 404 when 'click' then null
        when 'view' then case when {e} % 9 = 0 then 429 else 200 end else 200 end as http_status,
      cast({e} % 4 + 1 as int) as attempt, {e} % 3000 as duration_ms,
      case when event_type = 'error' then 'HTTP 500' when event_type = 'click' then 'timeout' end as error,
      {d.arr("'a' || cast(event_id as string)", "'b'")} as redirect_chain, 1704067200 + {e} as {d.q('at')}
    from {d.t('events')}"""


def queue(d) -> str:
    o = "o_orderkey"
    state = (
        f"case when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'F' then 'done' "
        f"when {o} % 3 = 0 then 'failed' when {o} % 3 = 1 then 'skipped' else 'running' end"
    )
    return f"""select {o} + 1 as id, 't' || cast(o_custkey % 20 as string) as task_id, {site('o_custkey')} as site_id,
      {nid('o_custkey')} as node_id, cast({o} % 6 as int) as depth, cast(-({o} % 6) as int) as priority, {state} as state,
      cast({o} % 4 as int) as attempts, case when {o} % 3 = 0 then 1700000000 + {o} % 1000 end as next_retry_at,
      'h' || cast(o_custkey % 50 as string) || '.example.com' as host
    from {d.t('orders')}"""


def command_rows(e: str) -> tuple[str, str]:
    """Kind and node (or restored operation) of command ``e``."""
    kind = f"""case when event_type = 'error' then case when {e} % 3 = 0 then 'redo' else 'undo' end
      when event_type = 'signup' and {e} % 4 = 0 then 'revert' when event_type = 'signup' and {e} % 4 = 1 then 'restore' else 'append' end"""
    return kind, f"case when event_type = 'signup' and {e} % 4 = 1 then 'g' || cast({e} - 1 - {e} % 7 as string) else {nid(f'{e} % 97')} end"


def commands(d) -> str:
    """The correction log: every seventh append writes two rows."""
    e = "event_id"
    kind, node = command_rows(e)
    head = f"select 's' || cast(user_id % 10 as string) as site_id, {e} as seq, "
    return f"""{head} {kind} as command, 'g' || cast({e} as string) as op_group, {node} as node_id from {d.t('events')}
    union all {head} 'append' as command, 'g' || cast({e} as string) as op_group, {nid(f'({e} + 31) % 97')} as node_id
    from {d.t('events')} where {e} % 7 = 0 and event_type not in ('error', 'signup')"""


def robots(d) -> str:
    m = "min(page_id)"
    nl = "chr(10)"
    lines = [
        "'User-agent: other'", "'Disallow: /'", "'Sitemap: ' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/map.xml'",
        "'User-agent: *'", f"'Disallow: /en/' || cast({m} % 10 as string)",
        f"'Allow: /en/' || cast({m} % 10 as string) || '5 # kept'", "'Disallow: /*.html$'", "''", "'no field'",
    ]
    special = [
        "'USER-AGENT: Loom'", "'Disallow: /fr # closed'", "'Disallow:'", f"'Crawl-delay: ' || cast({m} % 5 as string)",
        "'Allow: /fr/1'",
    ]
    group = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
    return f"""select {group} as origin, {f" || {nl} || ".join(lines)} || case when {m} % 2 = 0 then {nl} || {f" || {nl} || ".join(special)} else '' end as text
    from {d.t('pages')} group by {group}"""


def clicks(d) -> str:
    """Clicks and navigations per user, with event time in ms derived from the event number."""
    e = "event_id"
    return f"""select cast(user_id as string) as session_id, {e} * 500 as at_ms, {e} as event_id, event_type = 'click' as is_click,
      case when {e} % 8 = 0 then 'button' else 'a' end as tag, case when {e} % 11 = 0 then '_BLANK' end as target,
      {e} % 13 = 0 as ctrl, {e} % 6 <> 0 as has_href, {nid(f'{e} % {d.n}')} as from_node, cast({e} % 60 as int) as from_depth,
      'https://s0.example.com/n/' || cast({e} % 40 as string) || case when {e} % 4 = 0 then '#f' else '' end as url
    from {d.t('events')} where event_type in ('click', 'view')"""


FIXTURES: dict[str, Callable[[object], str]] = {
    f.__name__: f
    for f in (nodes, overrides, ops, edges, materials, sites, fetch_logs, queue, commands, robots, clicks)
}


class Tables:
    """The given tables of one folder, and the inputs derived from them."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name](self.dialect))
        raise AttributeError(name)

    @cached_property
    def dialect(self) -> SparkDialect:
        return SparkDialect(self.customer.count())

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in BASE_TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)

    @property
    def effective(self) -> DataFrame:
        from ..operators.effective import effective_nodes

        return effective_nodes(self.nodes, self.overrides)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EFFECTIVE_CTES = """
 ov as (select * from (select *, row_number() over (partition by node_id, field order by seq desc, id desc) as rn
        from overrides where not undone) where rn = 1),
 eff as (select n.id, n.site_id, n.identity_key, coalesce(u.value, n.url) as url, coalesce(a.value, n.alias) as alias,
     coalesce(nullif(a.value, ''), nullif(ti.value, ''), n.display_label) as display_label,
     coalesce(ti.value, n.title) as title, n.http_status, n.content_type, n.depth,
     coalesce(p.value, n.auto_parent_id) as effective_parent_id, n.auto_parent_id, n.status, n.content_hash,
     n.in_link_count, n.out_link_count, coalesce(de.value = '1', n.is_deleted) as is_deleted, n.is_deleted as base_deleted,
     exists (select 1 from overrides o where o.node_id = n.id and not o.undone) as has_override,
     n.first_seen_at, n.last_fetch_at
   from nodes n
   left join ov p on p.node_id = n.id and p.field = 'parent' left join ov u on u.node_id = n.id and u.field = 'url'
   left join ov a on a.node_id = n.id and a.field = 'alias' left join ov ti on ti.node_id = n.id and ti.field = 'title'
   left join ov de on de.node_id = n.id and de.field = 'deleted')"""


def oracle(body: str, *fixtures: str) -> str:
    """Put the named inputs (and ``eff``) in front of ``body``.

    ``body`` is a SELECT, or starts with a comma and further CTEs.
    """
    d = DuckDialect()
    names = list(fixtures)
    parts = []
    with_eff = "eff" in names
    if with_eff:
        names.remove("eff")
        names += [n for n in ("nodes", "overrides") if n not in names]
    parts += [f"{n} as ({FIXTURES[n](d)})" for n in names]
    if with_eff:
        parts.append(EFFECTIVE_CTES)
    body = body.strip()
    if not parts:
        return ("with recursive " + body[1:].strip()) if body.startswith(",") else body
    return "with recursive " + ",\n".join(parts) + ("\n" if body.startswith(",") else "\n") + body


def query(name: str, sql: str | None = None, *fixtures: str):
    """Register a query; ``sql`` is its DuckDB counterpart."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = oracle(sql, *fixtures)
        return fn

    return add
