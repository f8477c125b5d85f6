"""Click pairing against a plain queue, and streams against batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from linkloom.operators import guards as G
from linkloom.streaming import keyed as K
from linkloom.streaming import live as L
from linkloom.streaming import pairing as P
from linkloom.streaming import replay as R
from linkloom.streaming.runner import latest, run_available, run_with_state
from linkloom.plans.stage import new_path

WINDOW = 4000
DDL = (
    "session_id string, at_ms long, event_id long, is_click boolean, nonnav boolean, has_href boolean, "
    "from_node string, from_depth int, url string"
)


def make(seed, n=400):
    rnd = random.Random(seed)
    rows, at = [], {s: 1_704_067_200_000 for s in "abc"}
    for i in range(n):
        s = rnd.choice("aaab" + "c")
        at[s] += rnd.choice([1, 300, 1500, 5000])
        rows.append((s, at[s], i, rnd.random() < 0.6, rnd.random() < 0.3, rnd.random() < 0.5, f"n{i % 7}", i % 60, f"https://x/{i % 9}"))
    return rows


def expected(rows):
    """Oldest live click first; a click that opens elsewhere is passed once."""
    out = {}
    for s in {r[0] for r in rows}:
        waiting = []
        for _, at, eid, is_click, nonnav, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if is_click:
                waiting.append((at, eid, nonnav))
                continue
            for c in [c for c in waiting if c[0] + WINDOW < at]:
                out[c[1]] = ("unpaired", None)
                waiting.remove(c)
            if waiting and waiting[0][2]:
                out[waiting.pop(0)[1]] = ("unpaired", None)
                if not waiting:
                    continue
            elif not waiting:
                continue
            out[waiting.pop(0)[1]] = ("paired", eid)
        for c in waiting:
            out[c[1]] = ("unpaired", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing(spark, seed):
    rows = make(seed)
    df = spark.createDataFrame(rows, DDL)
    got = {r.click_id: (r.outcome, r.nav_id) for r in P.pair_clicks(df, WINDOW).collect()}
    assert got == expected(rows)


def test_pairing_cases(spark):
    rows = [
        ("s", 0, 1, True, False, True, "n", 0, None),
        ("s", 5000, 2, False, False, False, None, None, "https://x/a"),  # too late for 1
        ("s", 6000, 3, True, True, True, "n", 0, None),
        ("s", 6100, 4, True, True, True, "n", 0, None),
        ("s", 6200, 5, False, False, False, None, None, "https://x/b"),  # passes 3, takes 4 unchecked
    ]
    got = {r.click_id: (r.outcome, r.nav_id) for r in P.pair_clicks(spark.createDataFrame(rows, DDL), WINDOW).collect()}
    assert got == {1: ("unpaired", None), 3: ("unpaired", None), 4: ("paired", 5)}


def test_long_queues(spark):
    rows = [("s", i, i, True, False, True, "n", 0, None) for i in range(320)] + [("s", 400, 400, False, False, False, None, None, "https://x/q")]
    df = spark.createDataFrame(rows, DDL)
    whole = {r.click_id: r.outcome for r in P.pair_clicks(df, WINDOW).collect()}
    assert len(whole) == 320 and [i for i, o in whole.items() if o == "paired"] == [0]
    short = P.pair_clicks(df, WINDOW, max_waiting=300).filter("reason = 'queue full'")
    assert {r.click_id for r in short.collect()} == set(range(20))


def test_reasons(spark):
    rows = [
        ("s", 0, 1, True, False, True, "n", 0, None), ("s", 10, 2, True, False, False, "n", 0, None), ("s", 9000, 3, False, False, False, None, None, "u"),
        ("s", 9100, 4, True, True, True, "n", 0, None), ("s", 9200, 5, False, False, False, None, None, "u"), ("s", 9300, 6, True, False, True, "n", 0, None),
        (None, 1, 7, True, False, True, "n", 0, None),
    ]
    got = {r.click_id: r.reason for r in P.pair_clicks(spark.createDataFrame(rows, DDL), WINDOW).collect()}
    assert got == {1: "anchor or script", 2: "no navigation", 4: "opens elsewhere", 6: "no navigation"}
    assert P.pair_clicks(spark.createDataFrame([], DDL), WINDOW).count() == 0


def test_session_without_pause(spark):
    """One session, a click or navigation every second: no place to cut it."""
    rnd = random.Random(9)
    rows = [("s", 1000 * i, i, rnd.random() < 0.55, rnd.random() < 0.4, True, "n", 0, "u") for i in range(600)]
    got = {r.click_id: (r.outcome, r.nav_id) for r in P.pair_clicks(spark.createDataFrame(rows, DDL), WINDOW).collect()}
    assert got == expected(rows)


def in_batches(spark, df, order, n=3):
    """A stream over ``n`` files, one per micro-batch."""
    path = new_path(spark, "test-stream")
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_pairing_stream_equals_batch(spark):
    rows = make(5, 200)
    df = spark.createDataFrame(rows, DDL).withColumn("ts", F.timestamp_millis("at_ms"))
    stream = in_batches(spark, df, ["at_ms"])
    out, checkpoint = run_with_state(P.pair_clicks_stream(stream, WINDOW, "5 minutes"), "append")
    both = out.select("click_id", "outcome", "nav_id").unionByName(P.left_waiting(spark, checkpoint).select("click_id", "outcome", "nav_id"))
    got = [(r.click_id, (r.outcome, r.nav_id)) for r in both.collect()]
    assert dict(got) == expected(rows) and len(got) == len(dict(got))
    assert out.select("batch_id").distinct().count() > 1


def test_pairing_stream_steps_rows():
    """Rows of a session are stepped through as they are; a session that leaves nothing waiting makes few state calls."""
    rows = [("s", i * 10, i, i % 2 == 0, False, True, "n", None, "u") for i in range(200)]
    fields = Row(*[f.split()[0] for f in DDL.split(", ")])
    store = Store()
    processor = P.PairingState(WINDOW)
    processor.init(store)
    out = list(processor.handleInputRows(("s",), (fields(*r) for r in reversed(rows)), None))
    assert {r.click_id: (r.outcome, r.nav_id) for r in out} == expected(rows)
    assert store.calls <= 3


def test_manual_graph(spark):
    rows = [("s", i, i, "paired", None, i, "p", 50 + i, u) for i, u in enumerate(["https://x/a#f", "https://x/a#f", "https://x/a", "bad url"])]
    df = spark.createDataFrame(rows, P.RESULT)
    edges, nodes = P.manual_graph(df, F.lit("site"))
    assert [r.depth for r in P.manual_graph(df, F.lit("site"), max_depth=50)[1].collect()] == [50]
    assert {(r.fragment, r.click_id, r.clicks) for r in edges.collect()} == {("f", 0, 2), (None, 2, 1)}
    assert [(r.identity_key, r.depth) for r in nodes.collect()] == [("https://x/a", 51)]


def test_guards(spark):
    hits = spark.createDataFrame([("s", f"/a/{i}", i) for i in range(1, 6)] + [("s", "/ab", 9)], "site_id string, pathname string, seq long")
    links = spark.createDataFrame([("s", "/a/99", 4), ("s", "/a/99", 5), ("s", "/b/1", 9), ("s", "/ab", 99)], "site_id string, pathname string, from_seq long")
    got = [(r.pathname, r.from_seq, r.pruned_by) for r in G.prune_prefixes(links, hits, 3).orderBy("pathname", "from_seq").collect()]
    assert got == [("/a/99", 4, None), ("/a/99", 5, "/a"), ("/ab", 99, None), ("/b/1", 9, None)]
    attempts = spark.createDataFrame([(1, 500), (2, 500), (3, 500), (9, None), (1, 404), (6, 500)], "attempt int, http_status int")
    plan = [(r.retry, r.delay_ms) for r in G.retry_plan(attempts, 9, 100, 400).collect()]
    assert plan == [(True, 100), (True, 200), (True, 400), (True, 400), (False, 0), (True, 400)]
    paged = spark.createDataFrame([("s", "k", i) for i in range(5)] + [("s", None, 9)], "site_id string, series_key string, link_seq long")
    carried = spark.createDataFrame([("s", "k", 2)], "site_id string, series_key string, used long")
    assert {r.link_seq for r in G.limit_pagination(paged, 3).collect()} == {0, 1, 2, 9}
    assert {r.link_seq for r in G.limit_pagination(paged, 3, carried).collect()} == {0, 9}


class Log:
    """One site's correction log, step by step."""

    def __init__(self):
        self.rows, self.ops, self.done, self.undone = [], {}, [], []

    def switch(self, op, on):
        for r in self.ops[op]["rows"]:
            self.rows[r]["live"] = on != self.ops[op]["revert"]

    def push(self, op, revert, rows, seq, node):
        for o in reversed(self.undone):
            self.switch(o, False)
            self.ops[o]["state"] = "discarded"
        self.undone = []
        if op is not None:
            self.ops[op] = {"revert": revert, "rows": rows, "seq": seq, "node": node, "state": "applied"}
            self.done.append(op)

    def step(self, seq, command, op, node):
        if command == "append":
            self.push(None if op in self.ops else op, False, [], seq, node)
            self.ops[op]["rows"].append(len(self.rows))
            self.rows.append({"op": op, "node": node, "live": True, "seq": seq})
        elif command in ("revert", "restore"):
            rows = [n for n, r in enumerate(self.rows) if (r["node"] == node and r["live"] if command == "revert" else r["op"] == node)]
            if rows or command == "restore":
                for n in rows:
                    self.rows[n]["live"] = False
                self.push(op, True, rows, seq, node)
        else:
            source, target, state = (self.done, self.undone, "redoable") if command == "undo" else (self.undone, self.done, "applied")
            if source:
                target.append(source.pop())
                self.switch(target[-1], command == "redo")
                self.ops[target[-1]]["state"] = state

    def result(self, commands):
        for seq, command, op, node in sorted(commands, key=lambda c: (c[0], c[3] or "")):
            self.step(seq, command, op, node)
        out = [(r["seq"], "append", r["op"], r["node"], self.ops[r["op"]]["state"], r["live"]) for r in self.rows]
        return sorted(map(repr, out + [(o["seq"], "revert", name, o["node"], o["state"], None) for name, o in self.ops.items() if o["revert"]]))


COMMANDS = "site_id string, seq long, command string, op_group string, node_id string"


def commands(seed, n, weights):
    rnd, out = random.Random(seed), []
    for i in range(n):
        kind = rnd.choices(["append", "batch", "revert", "restore", "undo", "redo"], weights)[0]
        if kind == "batch":
            out += [(i, "append", f"g{i}", f"n{k}") for k in rnd.sample(range(6), 3)]
        else:
            node = None if kind in ("undo", "redo") else f"g{rnd.randrange(max(1, i))}" if kind == "restore" else f"n{rnd.randrange(6)}"
            out.append((i, kind, None if node is None else f"g{i}", node))
    return out


LOGS = {f"s{n}": commands(n, 150, w) for n, w in enumerate([(6, 1, 0, 0, 3, 2), (2, 0, 0, 0, 4, 4), (3, 2, 2, 1, 4, 3), (3, 1, 3, 1, 6, 6), (1, 1, 1, 1, 5, 6), (4, 1, 2, 2, 2, 1)])}


def by_site(rows):
    out = {}
    for r in rows:
        out.setdefault(r.site_id, []).append(repr(tuple(r[c] for c in R.RESULT_COLUMNS[1:])))
    return {site: sorted(found) for site, found in out.items()}


def test_replay_against_steps(spark):
    df = spark.createDataFrame([(site, *c) for site, log in LOGS.items() for c in log], COMMANDS)
    assert by_site(R.replay(df).collect()) == {site: Log().result(log) for site, log in LOGS.items()}


def test_replay_deals_the_log_once(spark, monkeypatch):
    """The log is numbered, dealt for all walks, and dealt by height: no walk orders it anew."""
    deals, deal = [], type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *a: deals.append(a) or deal(self, *a))
    log = [(n, kind, f"g{n}", "n") for n, kind in enumerate(["append", "undo", "redo", "append", "undo", "append", "undo", "undo"])]
    df = spark.createDataFrame([("s", *c) for c in log], COMMANDS)
    assert by_site(R.replay(df).collect()) == {"s": Log().result(log)}
    assert len(deals) == 3


def test_replay_of_few_commands(spark):
    """Nothing to undo, reverts that are no operation, an undone revert, a discarded revert."""
    log = [(1, "undo", None, None), (2, "redo", None, None), (3, "revert", "r3", "n1"), (4, "append", "g4", "n1"), (5, "revert", "r5", "n1"), (6, "revert", "r6", "n1"), (7, "undo", None, None), (8, "undo", None, None), (9, "append", "g9", "n2"), (10, "undo", None, None), (11, "undo", None, None), (12, "redo", None, None)]
    df = spark.createDataFrame([("s", *c) for c in log] + [(None, 1, "append", "x", "y")], COMMANDS)
    assert by_site(R.replay(df).collect()) == {"s": Log().result(log)}
    assert R.replay(spark.createDataFrame([], COMMANDS)).count() == 0


def test_replay_stream_equals_steps(spark):
    df = spark.createDataFrame([(site, *c) for site, log in LOGS.items() for c in log], COMMANDS)
    out = run_available(R.replay_stream(in_batches(spark, df, ["seq", "node_id"])))
    rows = latest(out, "site_id", "seq", "command", "op_group", "node_id").collect()
    assert by_site(rows) == {site: Log().result(log) for site, log in LOGS.items()}


class Store:
    """A state handle in memory that counts its calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def getValueState(self, name, schema):
        return Variable(self, name)

    def getMapState(self, name, key, value):
        return Variable(self, name)


class Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def getValue(self, key):
        self.store.calls += 1
        return self.store.values.get((self.name, key))

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.values[self.name, key] = value

    def containsKey(self, key):
        return self.getValue(key) is not None

    def exists(self):
        return self.containsKey(None)

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)


@pytest.mark.parametrize("batches", [1, 5])
def test_replay_stream_state(batches, monkeypatch):
    """State is read and written by pages, also when few are held; results as step by step."""
    log = sorted(((i, c, g, n) for i, c, g, n in commands(7, 3000, (8, 1, 3, 1, 3, 2))), key=lambda c: (c[0], c[3] or ""))
    if batches > 1:
        monkeypatch.setattr(K, "HELD", 2)
    store, rows = Store(), {}
    size = -(-len(log) // batches)
    for at in range(0, len(log), size):
        processor = R.ReplayState()
        processor.init(store)
        part = pd.DataFrame([("s", *c) for c in log[at : at + size]], columns=R.COMMAND_COLUMNS)
        for out in processor.handleInputRows(("s",), iter([part]), None):
            for _, seq, command, op, node, state, live in out.itertuples(index=False):
                rows[seq, command, op, node] = (state, live)
    got = sorted(repr((*key, *value)) for key, value in rows.items())
    assert got == Log().result(log)
    assert batches > 1 or store.calls < len(log) / 4


def test_counts_of_periods_and_known_nodes(spark):
    day = 86_400_000
    rows = [("s", "a", i * 1000) for i in range(5)] + [("s", "a", 31 * day)] + [("s", "b", 31 * day + i) for i in range(2)] + [("s", "c", 62 * day)]
    df = spark.createDataFrame(rows, "site_id string, identity_key string, ms long").select("site_id", "identity_key", F.timestamp_millis("ms").alias("ts"))
    out = run_available(L.visit_counts(in_batches(spark, df, ["ts"]), 4))
    got = {(r.identity_key, r.visits, r.over_limit) for r in latest(out, "site_id", "identity_key", "period_start").collect()}
    assert got == {("a", 5, True), ("a", 1, False), ("b", 2, False), ("c", 1, False)}
    known = df.filter("identity_key = 'b'").distinct()
    new = run_available(L.new_nodes(in_batches(spark, df, ["ts"]), known), "append")
    assert {r.identity_key for r in new.collect()} == {"a", "c"}
