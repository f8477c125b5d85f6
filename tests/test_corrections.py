"""Corrections on a museum: hall → {egypt → {masks, boats → model}, shop, maps}."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import browse as B
from linkloom.operators import corrections as C
from linkloom.operators import effective as E
from linkloom.operators import graph as G
from linkloom.schemas import schema
from linkloom.operators import tour
from linkloom.plans import stage
from linkloom.streaming.replay import replay

TREE = {"hall": None, "egypt": "hall", "masks": "egypt", "boats": "egypt", "model": "boats", "shop": "hall", "maps": "hall"}


@pytest.fixture(scope="module")
def nodes(spark):
    depth = lambda n: 0 if TREE[n] is None else 1 + depth(TREE[n])
    rows = [(n, "s", n, f"https://x/{n}", None, n, None, 200, "text/html", depth(n), p, "ok", None, 0, 0, False, 0, None) for n, p in TREE.items()]
    return spark.createDataFrame(rows, schema("nodes"))


def overrides(spark, rows):
    full = [(i + 1, "s", n, f, v, None, g, i + 1, u, 0) for i, (n, f, v, g, u) in enumerate(rows)]
    return spark.createDataFrame(full, schema("overrides"))


def test_effective_values(spark, nodes):
    ov = overrides(spark, [
        ("model", "parent", "shop", "o1", False), ("model", "parent", "maps", "o2", True), ("maps", "title", "Old maps", "o3", False), ("maps", "alias", "", "o4", False),
        ("boats", "url", "https://x/ships", "o5", False), ("shop", "parent", None, "o6", False), ("masks", "deleted", "1", "o7", False), ("masks", "deleted", "0", "o8", True),
    ])
    eff = {r.id: r for r in E.effective_nodes(nodes, ov).collect()}
    assert (eff["model"].effective_parent_id, eff["model"].auto_parent_id) == ("shop", "boats")
    assert (eff["maps"].alias, eff["maps"].title, eff["maps"].display_label) == ("", "Old maps", "Old maps")
    assert eff["boats"].url == "https://x/ships" and eff["shop"].effective_parent_id == "hall"
    assert eff["masks"].is_deleted and not eff["masks"].base_deleted and not eff["egypt"].is_deleted
    assert {k for k in eff if eff[k].has_override} == {"model", "maps", "boats", "shop", "masks"}
    moved_out = {r.id: r.effective_parent_id for r in E.effective_nodes(nodes, ov, null_is_value=True).collect()}
    assert moved_out["shop"] is None and moved_out["model"] == "shop"


def test_moves(spark, nodes):
    eff = E.effective_nodes(nodes, overrides(spark, []))
    asked = {
        ("egypt", "model"): "descendant", ("egypt", "egypt"): "self", ("hall", "maps"): "descendant", ("model", "shop"): "ok", ("boats", "hall"): "ok",
        ("masks", "egypt"): "no_change", ("hall", None): "no_change", ("lost", "hall"): "not_found", ("maps", "lost"): "parent_not_found",
    }
    moves = spark.createDataFrame([("s", n, p) for n, p in asked], "site_id string, node_id string, new_parent_id string")
    assert {(r.node_id, r.new_parent_id): r.verdict for r in C.validate_moves(eff, moves).collect()} == asked


def test_delete_and_trash(spark, nodes):
    eff = E.effective_nodes(nodes, overrides(spark, []))
    ids = spark.createDataFrame([("model", 0), ("boats", 1), ("maps", 2)], "id string, pos int")
    rows = C.delete_subtrees(eff, ids, "g", 1)
    assert sorted(r.node_id for r in rows.collect()) == ["boats", "maps", "model"]
    ov = rows.select(
        F.monotonically_increasing_id().alias("id"), "site_id", "node_id", "field", "value", "prev_value", "op_group", "seq", "undone", F.lit(0).cast("long").alias("created_at")
    )
    eff = E.effective_nodes(nodes, ov)
    assert {r.node_id: r.affected_nodes for r in C.trash_view(eff, ov).collect()} == {"boats": 2, "maps": 1}
    left = {r.id: r.child_count for r in E.with_child_count(eff).collect()}
    assert left["hall"] == 2 and left["egypt"] == 1 and left["boats"] == 0


def test_cycles_stop(spark, nodes):
    eff = E.effective_nodes(nodes, overrides(spark, [("egypt", "parent", "model", "g", False)]))
    up = {r.ancestor for r in G.ancestors(eff).filter("node = 'boats'").collect()}
    assert up == {"egypt", "model"}
    assert {r.id for r in G.subtree(eff, eff.filter("id = 'model'").select("id")).collect()} == {"model", "egypt", "masks", "boats"}


def test_deep_walks_read_few_tables(spark):
    chain = spark.range(40).selectExpr("cast(id as string) as parent", "cast(id + 1 as string) as child")
    out = G.reachable(spark.createDataFrame([("0", "0")], "root string, id string"), chain)
    assert sorted((int(r.id), r.level) for r in out.collect()) == [(i, i) for i in range(41)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 12


def test_indent(spark, nodes):
    topo = nodes.select("id", F.col("auto_parent_id").alias("parent_id"), F.col("display_label").alias("label"))
    got = [("  " * r.level + r.id, r.is_last) for r in B.indent_order(topo).collect()]
    assert got == [("hall", True), ("  egypt", False), ("    boats", False), ("      model", True), ("    masks", True), ("  maps", False), ("  shop", True)]


class Model:
    """Operations as full timelines, rewritten on every command."""

    def __init__(self):
        self.line = []  # [name, rows, revert, state]
        self.rows = {}  # seq -> [op, node, live]

    def set_active(self, op, on):
        for s in op[1]:
            self.rows[s][2] = (not on) if op[2] else on

    def fork(self):
        for op in self.line:
            if op[3] == "redoable":
                self.set_active(op, False)
                op[3] = "discarded"

    def run(self, seq, command, name, node):
        if command == "append":
            self.fork()
            self.rows[seq] = [name, node, True]
            self.line.append([name, [seq], False, "applied"])
        elif command == "revert":
            live = [s for s, r in self.rows.items() if r[1] == node and r[2]]
            if live:
                for s in live:
                    self.rows[s][2] = False
                self.fork()
                self.line.append([name, live, True, "applied"])
        elif command == "restore":
            rows = [s for s, r in self.rows.items() if r[0] == node]
            for s in rows:
                self.rows[s][2] = False
            self.fork()
            self.line.append([name, rows, True, "applied"])
        elif command == "undo":
            done = [op for op in self.line if op[3] == "applied"]
            if done:
                self.set_active(done[-1], False)
                done[-1][3] = "redoable"
        else:
            waiting = [op for op in self.line if op[3] == "redoable"]
            if waiting:
                self.set_active(waiting[0], True)
                waiting[0][3] = "applied"


@pytest.mark.parametrize("seed", range(3))
def test_replay_matches_model(spark, seed):
    rnd = random.Random(seed)
    log, expected = [], {}
    for site in ("x", "y", "z"):
        m = Model()
        for seq in range(150):
            command = rnd.choices(["append", "undo", "redo", "revert", "restore"], [5, 4, 3, 1, 1])[0]
            node = f"g{rnd.randrange(150)}" if command == "restore" else f"n{rnd.randrange(6)}"
            if command == "restore" and not any(r[0] == node for r in m.rows.values()):
                command = "undo"
            log.append((site, seq, command, f"g{seq}", node))
            m.run(seq, command, f"g{seq}", node)
        for name, rows, revert, state in m.line:
            if revert:
                expected[(site, name)] = (state, None)
            else:
                expected[(site, name)] = (state, m.rows[rows[0]][2])
    rnd.shuffle(log)
    df = spark.createDataFrame(log, "site_id string, seq long, command string, op_group string, node_id string")
    got = {(r.site_id, r.op_group): (r.op_state, r.live) for r in replay(df).collect()}
    assert got == expected


def test_batches_keep_all_rows(spark):
    """Several rows under one seq and operation are undone, redone and reverted together, each reported once."""
    log = [("x", 1, "append", "b1", n) for n in ("n1", "n2", "n3")] + [("x", 2, "append", "b2", n) for n in ("n1", "n4")]
    log += [("x", 3, "undo", None, None), ("x", 4, "revert", "r", "n2"), ("x", 5, "append", "b3", "n5")]
    df = spark.createDataFrame(log, "site_id string, seq long, command string, op_group string, node_id string")
    got = sorted((r.op_group, r.node_id, r.op_state, r.live) for r in replay(df).collect() if r.command == "append")
    assert got == [
        ("b1", "n1", "applied", True), ("b1", "n2", "applied", False), ("b1", "n3", "applied", True),
        ("b2", "n1", "discarded", False), ("b2", "n4", "discarded", False), ("b3", "n5", "applied", True),
    ]


def brute_labels(tree):
    """Per node: all nodes above it, by climbing."""
    out = {}
    for n in tree:
        up, seen = tree.get(n), []
        while up in tree and up not in seen and up is not None:
            seen.append(up)
            up = tree.get(up)
        out[n] = set(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_against_climbing(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:02}" for i in range(60)]
    tree = {n: rnd.choice([None, "outside", *ids[: max(1, i)]]) if i % 9 else None for i, n in enumerate(ids)}
    if seed > 1:  # two cycles, one of a single node, with trees below
        tree |= {"n05": "n20", "n20": "n33", "n33": "n05", "n40": "n40"}
    nodes = spark.createDataFrame(list(tree.items()), "id string, effective_parent_id string")
    rows = {r.id: r for r in tour.labelled(nodes).collect()}
    above = brute_labels(tree)
    below = lambda u, v: rows[v].low <= rows[u].place <= rows[v].high and u != v
    assert sorted(r.place for r in rows.values()) == list(range(1, 61))
    for u in ids:
        on_ring = u in above[u]
        assert {v for v in ids if below(u, v)} == above[u] - {u}
        assert rows[u].size == 1 + len([w for w in ids if u in above[w] and w != u])
        assert (rows[u].loop is not None) == on_ring
    got = {(r.node, r.ancestor) for r in G.ancestors(nodes).collect() if r.ancestor in tree}
    assert got == {(u, v) for u in ids for v in above[u] if u != v}


def test_long_chain_takes_few_jobs(spark, monkeypatch):
    n, written = 2000, []
    original = stage.staged
    monkeypatch.setattr(tour, "staged", lambda df, label="stage": written.append(label) or original(df, label))
    chain = spark.range(n).selectExpr("lpad(cast(id as string), 5, '0') as id", "if(id = 0, null, lpad(cast(id - 1 as string), 5, '0')) as effective_parent_id")
    rows = tour.labelled(chain).orderBy("place").collect()
    assert [(r.depth, r.size, r.place) for r in rows] == [(i, n - i, i + 1) for i in range(n)]
    asked = spark.createDataFrame([("01999",), ("00003",)], "id string")
    assert tour.climbed(chain, asked).count() == 1999 + 3
    assert len(written) < 70


def test_deletes_and_lists_with_cycles(spark, nodes):
    eff = E.effective_nodes(nodes, overrides(spark, [("egypt", "parent", "model", "g", False)]))
    ids = spark.createDataFrame([("masks", 1), ("boats", 2), ("model", 3), ("shop", 4)], "id string, pos int")
    assert {r.node_id for r in C.delete_subtrees(eff, ids, "g", 1).collect()} == {"masks", "boats", "model", "egypt", "shop"}
    assert {r.id: r.affected_nodes for r in C.delete_impact(eff, ids).collect()} == {"masks": 1, "boats": 4, "model": 4, "shop": 1}
    topo = eff.select("id", F.col("effective_parent_id").alias("parent_id"), F.col("display_label").alias("label"))
    got = [("  " * r.level + r.id, r.loop) for r in B.indent_order(topo).collect()]
    assert got == [("boats", "boats"), ("  model", "boats"), ("    egypt", "boats"), ("      masks", None), ("hall", None), ("  maps", None), ("  shop", None)]


def test_deletes_are_not_broadcast(spark, small):
    """Tables of nodes are merged: what passes through the driver does not grow with them."""
    from linkloom.catalog import QUERIES

    out = QUERIES["delete_subtrees"](spark, small)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
