"""Streams, click pairing and replay of the correction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..streaming import live as LV
from ..streaming import pairing as P
from ..streaming import replay as R
from ..streaming.runner import latest, read_table_stream, run_available, run_with_state
from .base import command_rows, nid, query, site

START = 1_704_067_200
WINDOW_MS = 4_000


def event_stream(t):
    return read_table_stream(t.spark, t.directory, "events", t.events.schema).withColumn(
        "ts", F.timestamp_seconds(F.lit(START) + F.col("event_id") * 60)
    )


@query(
    "progress_stream",
    f"""select 't' || cast(user_id % 20 as string) as task_id, cast(floor(event_id * 60 / 21600) as bigint) as w, count(*) as snapshots, max(event_id) as event_id,
      arg_max(user_id, event_id) as user_id from events group by 1, 2""",
)
def _(t):
    stream = event_stream(t).select(
        F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("task_id"), "ts", "event_id", "user_id"
    )
    out = latest(run_available(LV.progress_snapshots(stream, "6 hours")), "task_id", "window_start")
    w = ((F.unix_seconds("window_start") - START) / 21600).cast("bigint")
    return out.select("task_id", w.alias("w"), "snapshots", "event_id", "user_id")


NODE_KEYS = f"{site('event_id')} as site_id, cast(event_id % 3001 as string) as identity_key"


def node_events(t):
    return event_stream(t).selectExpr("ts", f"{site('event_id')} as site_id", "cast(event_id % 3001 as string) as identity_key")


KNOWN = f"select {site('c_custkey')} as site_id, cast(c_custkey * 3 as string) as identity_key from customer"


@query("node_stream", f"select distinct {NODE_KEYS} from events except {KNOWN}")
def _(t):
    known = t.customer.selectExpr(f"{site('c_custkey')} as site_id", "cast(c_custkey * 3 as string) as identity_key")
    return run_available(LV.new_nodes(node_events(t), known), "append").select("site_id", "identity_key")


@query("visit_stream", f"select {NODE_KEYS}, cast(floor(({START} + event_id * 60) / 2592000) as bigint) as period, count(*) as visits, count(*) > 3 as over_limit from events group by 1, 2, 3")
def _(t):
    out = latest(run_available(LV.visit_counts(node_events(t), 3)), "site_id", "identity_key", "period_start")
    return out.select("site_id", "identity_key", (F.unix_seconds("period_start") / 2592000).cast("bigint").alias("period"), "visits", "over_limit")


@query(
    "event_tail",
    ", r as (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) select cast(user_id as string) as session_id, event_id from r where rn <= 40",
)
def _(t):
    events = t.events.withColumn("session_id", F.col("user_id").cast("string"))
    return LV.event_tail(events, 40, ("-event_id",)).select("session_id", "event_id")


#: One command after another, with the stacks and the live rows as lists.
REPLAY_SQL = """, c as materialized (select *, row_number() over (partition by site_id order by seq, node_id) as t from commands),
 born as (select site_id, op_group, min(t) as born, list(t order by t) as op_rows from c where command = 'append' group by 1, 2),
 held as (select site_id, node_id, list(t order by t) as node_rows from c where command = 'append' group by 1, 2),
 x as materialized (select c.*, born.born, born.op_rows, case c.command when 'revert' then held.node_rows when 'restore' then list_filter(goal.op_rows, lambda r: r < c.t) end as listed from c
   left join born on c.command = 'append' and born.site_id = c.site_id and born.op_group = c.op_group
   left join born goal on c.command = 'restore' and goal.site_id = c.site_id and goal.op_group = c.node_id
   left join held on c.command = 'revert' and held.site_id = c.site_id and held.node_id = c.node_id),
 w as (select distinct site_id, cast(0 as bigint) as t, cast([] as struct(op bigint, rev boolean, rows bigint[])[]) as done, cast([] as struct(op bigint, rev boolean, rows bigint[])[]) as undone,
     cast([] as bigint[]) as live, false as pushes from c
   union all select site_id, t,
     case when pushes then list_append(done, {op: t, rev: command <> 'append', rows: mine}) when command = 'undo' and len(done) > 0 then list_slice(done, 1, len(done) - 1)
       when command = 'redo' and len(undone) > 0 then list_append(done, undone[len(undone)]) else done end,
     case when forks then [] when command = 'undo' and len(done) > 0 then list_append(undone, done[len(done)])
       when command = 'redo' and len(undone) > 0 then list_slice(undone, 1, len(undone) - 1) else undone end,
     case when forks then list_concat(list_reduce(list_prepend({rev: false, rows: case when command = 'append' then live else list_filter(live, lambda r: not list_contains(mine, r)) end},
           list_transform(list_reverse(undone), lambda o: {rev: o.rev, rows: o.rows})),
         lambda p, q: {rev: false, rows: case when q.rev then list_distinct(list_concat(p.rows, q.rows)) else list_filter(p.rows, lambda r: not list_contains(q.rows, r)) end}).rows,
         case when command = 'append' then [t] else [] end)
       when command = 'undo' and len(done) > 0 then case when done[len(done)].rev then list_distinct(list_concat(live, done[len(done)].rows)) else list_filter(live, lambda r: not list_contains(done[len(done)].rows, r)) end
       when command = 'redo' and len(undone) > 0 then case when undone[len(undone)].rev then list_filter(live, lambda r: not list_contains(undone[len(undone)].rows, r)) else list_distinct(list_concat(live, undone[len(undone)].rows)) end
       else live end,
     pushes
   from (select *, case command when 'append' then true when 'restore' then true when 'revert' then len(mine) > 0 else false end as forks,
       case command when 'append' then t = born when 'restore' then true when 'revert' then len(mine) > 0 else false end as pushes
     from (select x.site_id, x.t, x.command, x.born, w.done, w.undone, w.live, case x.command when 'append' then op_rows when 'restore' then coalesce(listed, [])
         when 'revert' then list_filter(coalesce(listed, []), lambda r: r < x.t and list_contains(w.live, r)) else [] end as mine
       from w join x on x.site_id = w.site_id and x.t = w.t + 1))),
 wm as materialized (select * from w),
 fin as (select site_id, arg_max(list_transform(done, lambda o: o.op), t) as done, arg_max(list_transform(undone, lambda o: o.op), t) as undone, arg_max(live, t) as live from wm group by 1),
 pushed as (select x.site_id, x.t as own, x.t, x.seq, 'revert' as command, x.op_group, x.node_id from x join wm using (site_id, t) where pushes and x.command <> 'append'
   union all select site_id, born, t, seq, command, op_group, node_id from x where command = 'append'),
 st as (select site_id, seq, command, op_group, node_id, case when list_contains(done, own) then 'applied' when list_contains(undone, own) then 'redoable' else 'discarded' end as op_state,
   case when command = 'append' then list_contains(live, t) end as live from pushed join fin using (site_id))"""


@query("override_replay", REPLAY_SQL + " select site_id, seq, command, op_group, node_id, op_state, live from st", "commands")
def _(t):
    return R.replay(t.commands)


@query("replay_depths", REPLAY_SQL + " select site_id, count(distinct op_group) filter (where op_state = 'applied') as undo_depth, count(distinct op_group) filter (where op_state = 'redoable') as redo_depth from st group by 1", "commands")
def _(t):
    ops = R.op_states(R.replay(t.commands))
    return ops.groupBy("site_id").agg(
        F.count_if(F.col("op_state") == "applied").alias("undo_depth"),
        F.count_if(F.col("op_state") == "redoable").alias("redo_depth"),
    )


@query("replay_stream", REPLAY_SQL + " select site_id, seq, command, op_group, node_id, op_state, live from st", "commands")
def _(t):
    stream = read_table_stream(t.spark, t.directory, "events", t.events.schema)
    kind, node = command_rows("event_id")
    second = f"if(event_id % 7 = 0 and event_type not in ('error', 'signup'), array({node}, {nid('(event_id + 31) % 97')}), array({node}))"
    commands = stream.selectExpr("'s' || cast(user_id % 10 as string) as site_id", "event_id as seq", f"{kind} as command", "'g' || cast(event_id as string) as op_group", f"explode({second}) as node_id")
    out = latest(run_available(R.replay_stream(commands)), "site_id", "seq", "command", "op_group", "node_id")
    return out.select("site_id", "seq", "command", "op_group", "node_id", "op_state", "live")


def click_events(t):
    nonnav = P.is_nonnav(F.col("target"), F.col("ctrl"), F.lit(False), F.lit(False), F.col("tag"))
    return t.clicks.withColumn("nonnav", nonnav).select(*P.EVENT_COLUMNS)


@query("nonnav_click", "select event_id, event_id % 11 = 0 or event_id % 13 = 0 or event_id % 8 = 0 as nonnav from clicks where is_click", "clicks")
def _(t):
    return click_events(t).filter("is_click").select("event_id", "nonnav")


@query(
    "click_bursts",
    f""", p as (select *, lag(at_ms) over (partition by session_id order by at_ms, event_id) as prev from clicks)
 select event_id, max(case when prev is null or at_ms - prev > {WINDOW_MS * 10} then at_ms end) over (partition by session_id order by at_ms, event_id) as burst from p""",
    "clicks",
)
def _(t):
    return P.bursts(click_events(t), WINDOW_MS * 10).select("event_id", "burst")


def pair_sql(source: str, window_ms: int) -> str:
    """Step through each session's events with the waiting clicks as a list."""
    item = "{'at': at_ms, 'id': event_id, 'nonnav': nonnav}"
    live = f"list_filter(w.q, lambda x: x.at + {window_ms} >= c.at_ms)"
    return f"""pe as materialized (select *, row_number() over (partition by session_id order by at_ms, event_id) as rn from {source}),
 w as (select session_id, rn, event_id, case when is_click then [{item}] else cast([] as struct("at" bigint, id bigint, nonnav boolean)[]) end as q, cast(null as bigint) as hit from pe where rn = 1
   union all select c.session_id, c.rn, c.event_id,
     case when c.is_click then list_append(w.q, {item.replace('at_ms', 'c.at_ms').replace('event_id', 'c.event_id').replace(': nonnav', ': c.nonnav')})
          when len({live}) > 0 and {live}[1].nonnav then {live}[3:] else {live}[2:] end,
     case when c.is_click then null when len({live}) = 0 then null when {live}[1].nonnav then {live}[2].id else {live}[1].id end
   from w join pe c on c.session_id = w.session_id and c.rn = w.rn + 1),
 paired as materialized (select hit as click_id, event_id as nav_id from w where hit is not null)"""


CLICKS = "(select *, event_id % 11 = 0 or event_id % 13 = 0 or event_id % 8 = 0 as nonnav from clicks)"
PAIRS = ", " + pair_sql(CLICKS, WINDOW_MS * 10)
MANUAL = PAIRS + """, hits as (select c.event_id as click_id, c.session_id, c.from_node, c.from_depth, regexp_replace(n.url, '#.*$', '') as identity_key,
   nullif(regexp_extract(n.url, '#(.+)$', 1), '') as fragment from paired p join clicks c on c.event_id = p.click_id join clicks n on n.event_id = p.nav_id),
 firsts as (select from_node, identity_key, fragment, min(click_id) as click_id from hits group by all)"""


@query(
    "click_pairing",
    PAIRS + " select c.session_id, c.event_id as click_id, case when p.nav_id is null then 'unpaired' else 'paired' end as outcome, p.nav_id from clicks c left join paired p on p.click_id = c.event_id where c.is_click",
    "clicks",
)
def _(t):
    return P.pair_clicks(click_events(t), WINDOW_MS * 10).select("session_id", "click_id", "outcome", "nav_id")


@query(
    "click_totals",
    "select session_id, count(*) filter (where is_click) as clicks from clicks group by 1 having count(*) filter (where is_click) > 0",
    "clicks",
)
def _(t):
    """Every click gets exactly one outcome."""
    return P.pair_clicks(click_events(t), WINDOW_MS * 10).groupBy("session_id").agg(F.count_distinct("click_id").alias("clicks"))


@query(
    "click_stats",
    MANUAL + """ select c.session_id, count(*) as total, count(p.nav_id) as paired, count(*) - count(p.nav_id) as unpaired,
   count(*) filter (where p.nav_id is not null and c.event_id not in (select click_id from firsts)) as skipped_duplicate
 from clicks c left join paired p on p.click_id = c.event_id where c.is_click group by 1""",
    "clicks",
)
def _(t):
    paired = P.pair_clicks(click_events(t), WINDOW_MS * 10)
    edges, _ = P.manual_graph(paired, F.lit("s0"))
    first = edges.select(F.col("click_id").alias("_first"))
    flagged = paired.join(first, paired["click_id"] == first["_first"], "left").withColumn("is_duplicate", F.col("_first").isNull())
    return S.click_stats(flagged)


@query(
    "manual_edges",
    MANUAL + """, d as (select identity_key, arg_min(from_depth, click_id) + 1 as depth from hits group by 1)
 select from_node, f.identity_key, fragment, click_id, depth, 'manual' as source from firsts f join d on d.identity_key = f.identity_key""",
    "clicks",
)
def _(t):
    edges, nodes = P.manual_graph(P.pair_clicks(click_events(t), WINDOW_MS * 10), F.lit("s0"))
    depths = nodes.select("identity_key", "depth")
    return edges.join(depths, "identity_key").select("from_node", "identity_key", "fragment", "click_id", "depth", "source")


STREAMED = "(select *, event_id % 11 = 0 or event_id % 13 = 0 or event_id % 8 = 0 as nonnav from (select cast(user_id as string) as session_id, event_id * 60000 as at_ms, event_id, event_type = 'click' as is_click from events where event_type in ('click', 'view')))"


@query(
    "pairing_stream",
    ", " + pair_sql(STREAMED, 4 * 3600 * 1000) + " select c.session_id, c.event_id as click_id, case when p.nav_id is null then 'unpaired' else 'paired' end as outcome, p.nav_id from pe c left join paired p on c.event_id = p.click_id where c.is_click",
)
def _(t):
    """Streaming form over the raw events: every click, with those that still wait at the end."""
    stream = event_stream(t).filter("event_type in ('click', 'view')")
    e = F.col("event_id")
    shaped = stream.select(
        "ts",
        F.col("user_id").cast("string").alias("session_id"),
        (F.unix_millis("ts")).alias("at_ms"),
        "event_id",
        (F.col("event_type") == "click").alias("is_click"),
        ((e % 8 == 0) | (e % 11 == 0) | (e % 13 == 0)).alias("nonnav"),
        (e % 6 != 0).alias("has_href"),
        e.cast("string").alias("from_node"),
        (e % 60).cast("int").alias("from_depth"),
        F.concat(F.lit("https://s0.example.com/n/"), (e % 40).cast("string")).alias("url"),
    )
    out, checkpoint = run_with_state(P.pair_clicks_stream(shaped, 4 * 3600 * 1000), "append")
    columns = ("session_id", "click_id", "outcome", "nav_id")
    return out.select(*columns).unionByName(P.left_waiting(t.spark, checkpoint).select(*columns))


CAPTURE = """case when event_id % 7 = 0 then 'no json' when event_id % 7 = 1 then '{"kind":"hover"}'
  else '{"kind":"click","tag":"a","href":"/x' || cast(event_id as string) || '","ctrlKey":' || case when event_id % 2 = 0 then 'true' else 'false' end || ',"x":' || cast(event_id % 100 as string) || '}' end"""
PAYLOAD = "case when event_id % 5 = 0 then '[' || cast(event_id as string) || ',' || cast(event_id + 1 as string) || ']' when event_id % 5 = 1 then 'oops' when event_id % 5 = 2 then null else '[]' end"


@query(
    "json_fields",
    """select event_id, cast(props->>'$.k' as int) as k, case when event_id % 7 > 1 then 'a' end as tag, case when event_id % 7 > 1 then '/x' || event_id end as href,
      case when event_id % 7 > 1 then event_id % 2 = 0 end as ctrl, case when event_id % 7 > 1 then cast(event_id % 100 as int) end as x,
      case when event_id % 5 = 0 then 2 else 0 end as n_ids, case when event_id % 5 = 0 then event_id end as first_id from events""",
)
def _(t):
    df = t.sql(f"select event_id, props, {CAPTURE} as capture, {PAYLOAD} as payload from {{events}}".replace('{"', '{{"').replace('"}', '"}}').replace("|| '}'", "|| '}}'"))
    df = df.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), P.parse_capture(F.col("capture")).alias("c"), P.parse_ids(F.col("payload")).alias("ids"))
    return df.select(
        "event_id", "k", "c.tag", "c.href", F.col("c.ctrlKey").alias("ctrl"), F.col("c.x").cast("int").alias("x"),
        F.size("ids").alias("n_ids"), F.get("ids", 0).alias("first_id"),
    )
