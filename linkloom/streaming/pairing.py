"""Pairing of clicks with the navigations they caused.

Each navigation takes the oldest waiting click that is not older than the
window.  Clicks that open elsewhere are passed over once: the click after one
is taken as it is.  The window bounds how many clicks wait; ``max_waiting`` lets the
oldest fall out of longer queues, for results made that way.

Clicks leave in the order in which they came, so the queue is a number: how many
are gone.  Running counts by range give the bounds of that number for every
navigation, and pointer doubling the number itself, so that one session, with or
without pauses, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.urls import normalize_url
from ..plans.ordered import running
from ..plans.stage import staged
from .keyed import Entries

DEFAULT_WINDOW_MS = 4000

EVENT_COLUMNS = ("session_id", "at_ms", "event_id", "is_click", "nonnav", "has_href", "from_node", "from_depth", "url")
RESULT = (
    "session_id string, click_id long, at_ms long, outcome string, reason string, nav_id long, "
    "from_node string, from_depth int, url string"
)


def is_nonnav(target: Column, ctrl: Column, meta: Column, shift: Column, tag: Column) -> Column:
    """Clicks that do not lead this page anywhere: new tab, modifier keys, form controls."""
    blank = F.coalesce(F.lower(target) == "_blank", F.lit(False))
    keys = F.coalesce(ctrl | meta | shift, F.lit(False))
    return blank | keys | F.coalesce(tag.isin("button", "input"), F.lit(False))


def bursts(events: DataFrame, window_ms: int) -> DataFrame:
    """Add ``burst``: start of the run of events without a gap longer than the window."""
    order = ["at_ms", "event_id"]
    with_prev = running(
        events, ["session_id"], order, {"_prev": ("max", F.col("at_ms"))}, exclusive=True
    )
    start = F.when(F.col("_prev").isNull() | (F.col("at_ms") - F.col("_prev") > window_ms), F.col("at_ms"))
    marked = with_prev.withColumn("_start", start).drop("_prev")
    return running(marked, ["session_id"], order, {"burst": ("max", F.col("_start"))}).drop("_start")


def _numbered(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks with their number in the session (``i``), navigations with theirs (``k``) and the clicks before them (``seen``)."""
    counts = {"i": ("sum", F.col("is_click").cast("bigint")), "k": ("sum", (~F.col("is_click")).cast("bigint"))}
    rows = staged(running(events, ["session_id"], ["at_ms", "event_id"], counts), "numbered")
    clicks = rows.filter("is_click").drop("k", "url", "is_click")
    return clicks, rows.filter("not is_click").select("session_id", "k", F.col("i").alias("seen"), "at_ms", "event_id", "url")


def _swept(clicks: DataFrame, navs: DataFrame, window_ms: int) -> tuple[DataFrame, DataFrame]:
    """Navigations with the number of clicks too old for them (``old``); clicks with the navigation that finds them too old (``swept``: at_ms, event_id)."""
    marks = clicks.select("session_id", (F.col("at_ms") + window_ms).alias("at"), F.lit(1).alias("mark"), F.col("event_id").alias("id"), F.col("i").alias("n"))
    visits = navs.select("session_id", F.col("at_ms").alias("at"), F.lit(0).alias("mark"), F.col("event_id").alias("id"), F.col("k").alias("n"))
    both = marks.unionByName(visits)  # a navigation just at the end of the window still takes the click
    order = ["at", "mark", "id", "n"]
    counted = running(both, ["session_id"], order, {"old": ("sum", F.col("mark").cast("bigint"))}).filter("mark = 0").select("session_id", F.col("n").alias("k"), "old")
    ahead = {"swept": ("min", F.when(F.col("mark") == 0, F.struct("at", "id")))}
    ended = running(both, ["session_id"], [f"-{o}" for o in order], ahead).filter("mark = 1").select("session_id", F.col("n").alias("i"), "swept")
    return navs.join(counted, ["session_id", "k"]), ended


def _heads(navs: DataFrame, clicks: DataFrame) -> DataFrame:
    """(session_id, k, head): how many clicks are gone before navigation k takes its own.

    Where a navigation can find no click left from before its predecessor, its
    head is known.  Elsewhere it is one of the clicks still young enough, and each
    candidate leads to one candidate of the next navigation.  What is reached from
    the known heads is found by doubling: each round follows the links twice as
    far, so a session without a pause costs a logarithmic number of joins.
    """
    previous = navs.select("session_id", (F.col("k") + 1).alias("k"), F.col("seen").alias("had"))
    placed = navs.join(previous, ["session_id", "k"], "left").withColumn("known", F.expr("had is null or old >= had"))
    low, high = F.col("old"), F.when(F.col("known"), F.col("old")).otherwise(F.col("had"))
    states = staged(placed.select("session_id", "k", "seen", "known", F.explode(F.sequence(low, high)).alias("head")), "heads")
    following = placed.filter("not known").select("session_id", (F.col("k") - 1).alias("k"), F.col("old").alias("next_old"))
    first = clicks.select("session_id", (F.col("i") - 1).alias("head"), "nonnav")
    left = states.join(following, ["session_id", "k"]).join(first, ["session_id", "head"], "left")
    after = F.least("seen", F.col("head") + F.when(F.col("nonnav"), 2).otherwise(1))
    links = staged(left.select("session_id", "k", "head", (F.col("k") + 1).alias("to_k"), F.greatest(after, "next_old").alias("to_head")), "links")
    reached = states.filter("known").select("session_id", "k", "head")
    while links.take(1):
        more = reached.join(links, ["session_id", "k", "head"]).select("session_id", F.col("to_k").alias("k"), F.col("to_head").alias("head"))
        reached = staged(reached.unionByName(more), "reached")
        onward = links.select("session_id", F.col("k").alias("to_k"), F.col("head").alias("to_head"), F.col("to_k").alias("far_k"), F.col("to_head").alias("far_head"))
        links = staged(links.join(onward, ["session_id", "to_k", "to_head"]).select("session_id", "k", "head", F.col("far_k").alias("to_k"), F.col("far_head").alias("to_head")), "links")
    return reached


def pair_clicks(events: DataFrame, window_ms: int = DEFAULT_WINDOW_MS, max_waiting: int | None = None) -> DataFrame:
    """Outcome of every click (RESULT); ``events`` has EVENT_COLUMNS (clicks and navigations).

    Clicks are taken in order, so a navigation's click follows from how many are
    gone: taken, or too old (``_swept``), or, with ``max_waiting``, pushed out.
    A click that no navigation takes is "queue full" if it is pushed out first,
    "opens elsewhere" if it is passed over, "anchor or script" if it has a target
    and a later navigation finds it too old, and "no navigation" otherwise.
    Sessions of NULL are taken out.
    """
    clicks, navs = _numbered(events.select(*EVENT_COLUMNS).filter("session_id is not null"))
    navs, swept = _swept(clicks, navs, window_ms)
    if max_waiting is not None:
        navs = navs.withColumn("old", F.greatest("old", F.col("seen") - max_waiting))
    navs, clicks = staged(navs, "navigations"), staged(clicks.join(swept, ["session_id", "i"]), "clicks")
    found = _heads(navs, clicks).join(navs, ["session_id", "k"]).filter("head < seen")
    head = clicks.select("session_id", (F.col("i") - 1).alias("head"), F.col("nonnav").alias("passes"))
    met = found.join(head, ["session_id", "head"])
    taken = F.array(
        F.struct((F.col("head") + 1).alias("i"), F.col("passes").alias("passed")),
        F.struct((F.col("head") + 2).alias("i"), F.lit(False).alias("passed")),
    )
    size = F.when(F.col("passes") & (F.col("head") + 2 <= F.col("seen")), 2).otherwise(1)
    used = met.select("session_id", F.inline(F.slice(taken, 1, size)), F.col("event_id").alias("nav_id"), F.col("url").alias("nav_url"))
    out = clicks.join(used, ["session_id", "i"], "left")
    lost = F.when(F.col("passed"), "opens elsewhere")
    if max_waiting is not None:
        pusher = clicks.select("session_id", (F.col("i") - max_waiting).alias("i"), F.struct(F.col("at_ms").alias("at"), F.col("event_id").alias("id")).alias("pushed"))
        out = out.join(pusher, ["session_id", "i"], "left")
        lost = lost.when(F.col("pushed").isNotNull() & (F.col("swept").isNull() | (F.col("pushed") < F.col("swept"))), "queue full")
    lost = lost.when(F.col("swept").isNotNull() & F.col("has_href"), "anchor or script").otherwise("no navigation")
    paired = F.coalesce(~F.col("passed"), F.lit(False))
    return out.select(
        "session_id", F.col("event_id").alias("click_id"), "at_ms", F.when(paired, "paired").otherwise("unpaired").alias("outcome"),
        F.when(~paired, lost).alias("reason"), F.when(paired, F.col("nav_id")).alias("nav_id"), "from_node", "from_depth",
        F.when(paired, F.col("nav_url")).alias("url"),
    )


def manual_graph(paired: DataFrame, site_of: Column, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, node candidates) of paired clicks; repeated edges are flagged.

    The first click per (from, target, fragment) makes the edge.
    """
    hits = normalize_url(paired.filter(F.col("outcome") == "paired"), "url", "n").filter(F.col("n").isNotNull())
    hits = hits.withColumn("site_id", site_of)
    keys = ["site_id", "from_node", "identity_key", "fragment"]
    shaped = hits.select(
        "session_id", "click_id", "site_id", "from_node", "from_depth",
        F.col("n.identity_key").alias("identity_key"), F.col("n.fragment").alias("fragment"), F.col("n.url").alias("url"),
    )
    edges = shaped.groupBy(*keys).agg(F.min("click_id").alias("click_id"), F.count("*").alias("clicks")).withColumn(
        "source", F.lit("manual")
    )
    nodes = shaped.groupBy("site_id", "identity_key").agg(
        F.min_by("from_node", "click_id").alias("auto_parent_id"),
        F.least(F.min_by("from_depth", "click_id") + 1, F.lit(max_depth).cast("int")).alias("depth"),  # least skips NULL
    )
    return edges, nodes


_CAPTURE = (
    "kind string, tag string, anchorText string, selector string, domPath string, href string, rel string, "
    "target string, button double, ctrlKey boolean, metaKey boolean, shiftKey boolean, altKey boolean, "
    "x double, y double, at double"
)


def parse_capture(raw: Column) -> Column:
    """Click capture JSON with tolerant defaults; NULL unless ``kind`` is click."""
    j = F.from_json(raw, _CAPTURE)
    text = lambda n, d="": F.coalesce(j[n], F.lit(d)).alias(n)
    flag = lambda n: F.coalesce(j[n], F.lit(False)).alias(n)
    num = lambda n: F.coalesce(j[n], F.lit(0.0)).alias(n)
    shaped = F.struct(
        text("tag", "unknown"), text("anchorText"), text("selector"), text("domPath"), j["href"].alias("href"),
        j["rel"].alias("rel"), j["target"].alias("target"), num("button"), flag("ctrlKey"), flag("metaKey"),
        flag("shiftKey"), flag("altKey"), num("x"), num("y"), num("at"),
    )
    return F.when(j["kind"] == "click", shaped)


def parse_ids(raw: Column) -> Column:
    """JSON list of row ids; anything else is an empty list."""
    return F.coalesce(F.filter(F.from_json(raw, "array<bigint>"), lambda v: v.isNotNull()), F.array().cast("array<bigint>"))


OUTCOME = Row(*[f.split()[0] for f in RESULT.split(", ")])
CLICK_STATE = "at_ms long, event_id long, nonnav boolean, has_href boolean, from_node string, from_depth int"


class PairingState(StatefulProcessor):
    """Waiting clicks of one session: a numbered entry for each, and the numbers at both ends.

    A batch writes the clicks that it leaves waiting and removes those that it
    ends.  A timer of event time lets the oldest click out when no navigation can
    take it any more.
    """

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "i long", CLICK_STATE)
        self.ends = handle.getValueState("ends", "head long, tail long, alarm long")

    def _load(self) -> None:
        self.clicks = Entries(self.waiting)
        self.head, self.tail, self.alarm = self.ends.get() or (0, 0, None)
        self.out: list[tuple] = []

    def _take(self) -> tuple:
        click = self.clicks.get(self.head)
        self.clicks.put((self.head,), None)
        self.head += 1
        return click

    def _lost(self, key, click: tuple, reason: str) -> None:
        self.out.append((key[0], click[1], click[0], "unpaired", reason, None, click[4], click[5], None))

    def _expire(self, key, now: int) -> None:
        while self.head < self.tail and self.clicks.get(self.head)[0] + self.window_ms < now:
            click = self._take()
            self._lost(key, click, "anchor or script" if click[3] else "no navigation")

    def _navigate(self, key, row) -> None:
        self._expire(key, row.at_ms)
        if self.head < self.tail and self.clicks.get(self.head)[2]:
            self._lost(key, self._take(), "opens elsewhere")
        elif self.head == self.tail:
            return
        if self.head < self.tail:
            click = self._take()
            self.out.append((key[0], click[1], click[0], "paired", None, row.event_id, click[4], click[5], row.url))

    def _save(self) -> Iterator[Row]:
        due = self.clicks.get(self.head)[0] + self.window_ms + 1 if self.head < self.tail else None
        if due is not None and due != self.alarm:
            self.handle.registerTimer(due)
        self.clicks.flush()
        self.ends.update((self.head, self.tail, due))
        return map(OUTCOME, *zip(*self.out)) if self.out else iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        for row in sorted(rows, key=lambda row: (row.at_ms, row.event_id)):
            if row.is_click:
                self.clicks.put((self.tail,), (row.at_ms, row.event_id, bool(row.nonnav), bool(row.has_href), row.from_node, row.from_depth), new=True)
                self.tail += 1
            else:
                self._navigate(key, row)
        return self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self._expire(key, timerValues.getCurrentWatermarkInMs())
        return self._save()

    def close(self) -> None:
        pass


def pair_clicks_stream(events: DataFrame, window_ms: int = DEFAULT_WINDOW_MS, delay: str = "10 seconds") -> DataFrame:
    """Streaming form (RESULT, append) over events with ``ts``; clicks that nothing can take any more come out by event time.

    Needs the RocksDB state store, which ``runner.run_available`` sets.
    """
    shaped = events.withWatermark("ts", delay).select("ts", *EVENT_COLUMNS)
    return shaped.groupBy("session_id").transformWithState(PairingState(window_ms), RESULT, "Append", "EventTime")


def left_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Clicks that a stopped stream still holds, as RESULT without an outcome's navigation: read from its state store."""
    kept = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    null = F.lit(None)
    return kept.select(
        F.col("key.session_id").alias("session_id"), F.col("user_map_value.event_id").alias("click_id"), F.col("user_map_value.at_ms").alias("at_ms"),
        F.lit("unpaired").alias("outcome"), F.lit("no navigation").alias("reason"), null.cast("long").alias("nav_id"),
        F.col("user_map_value.from_node").alias("from_node"), F.col("user_map_value.from_depth").alias("from_depth"), null.cast("string").alias("url"),
    )
