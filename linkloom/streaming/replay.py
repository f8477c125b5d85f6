"""Replay of the correction log with undo and redo, as passes over the whole log.

Commands of a site move a cursor over its operations.  A new operation goes on
top of the cursor and everything above is discarded; undo lowers the cursor, redo
raises it up to the last operation that is not discarded.  Each pass orders the
log by ranges (``plans.ordered``), so one site lies in many tasks, and nothing is
stepped through row by row:

* Between two new operations, undo and redo are a walk that may not fall below
  zero (there is nothing to redo); a running sum and its running minimum tell
  which redos act (``_walked``).
* The cursor is such a walk again, over all operations (nothing to undo).  An
  undo that does nothing can take a later redo's object away; if so, it is taken
  out of the log and the walk is repeated.  Each repetition only finds undos that
  truly do nothing, so it ends with the exact cursor.
* The operation that an undo or redo acts on is the last one that was put at that
  height (``_acts``).  What is undone when the next operation begins is discarded.
* A row is set on or off by its own operation and by the reverts that list it;
  its last such event decides (``_settled``).
* A revert lists the rows of its node that are live just then, and does not exist
  if there are none.  That depends on the replay itself, so replay and lists are
  repeated until they agree.  Every round settles at least the earliest command
  that was still wrong, so the result is exact.

The stream form takes the commands of a micro-batch one after another and keeps
operations and rows in small pages of the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.ordered import dealt, running, running_walk, with_row_number
from ..plans.stage import staged
from .keyed import Named, Numbered, frame, ordered_rows

COMMAND_COLUMNS = ("site_id", "seq", "command", "op_group", "node_id")
RESULT_COLUMNS = ("site_id", "seq", "command", "op_group", "node_id", "op_state", "live")


def _named(column: str) -> Column:
    """An operation's name, with NULL as a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _log(commands: DataFrame) -> DataFrame:
    """The commands with their number ``t`` in the site, the ``op`` they belong to and the first row of an append's operation (``born``)."""
    rows = commands.select(*COMMAND_COLUMNS).filter("command in ('append', 'revert', 'restore', 'undo', 'redo')")
    numbered = with_row_number(rows, ["site_id"], ["seq", "node_id", "op_group", "command"], "t").withColumn("op", _named("op_group"))
    numbered = staged(numbered.withColumn("t", F.col("t").cast("bigint")), "log")
    first = numbered.filter("command = 'append'").groupBy(F.col("site_id").alias("_site"), F.col("op").alias("_op")).agg(F.min("t").alias("born"))
    met = numbered.join(first, (F.col("command") == "append") & F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("op") == F.col("_op")), "left")
    return staged(met.drop("_site", "_op"), "log")


def _walked(steps: DataFrame, idle: DataFrame | None) -> DataFrame:
    """The steps (site_id, t, command, first, in ranges) with ``acts`` (push, undo, redo or NULL), ``pos`` (height it acts on) and ``span`` (operations and forks so far).

    ``idle`` holds the reverts (site_id, t) that do nothing.
    """
    push = "command in ('revert', 'restore') or first"
    rows = steps
    if idle is not None:
        rows = rows.join(idle.withColumn("idle", F.lit(True)), ["site_id", "t"], "left").filter("idle is null").drop("idle")
    rows = rows.withColumn("fork", F.expr("command in ('append', 'revert', 'restore')")).withColumn("push", F.expr(f"coalesce({push}, false)"))
    rows = staged(running(rows, ["site_id"], ["t"], {"span": ("sum", F.col("fork").cast("bigint"))}).withColumn("void", F.lit(False)), "spans")
    while True:
        undone = F.expr("case when void or span = 0 then 0 when command = 'undo' then 1 when command = 'redo' then -1 else 0 end").cast("bigint")
        inner = running_walk(rows, ["site_id", "span"], ["t"], undone, total="w", lowest="w_low")
        redoing = inner.withColumn("redoing", F.expr("command = 'redo' and span > 0 and w >= w_low")).drop("w", "w_low")
        redoing = staged(redoing, "redoing")
        step = F.expr("case when push then 1 when void or span = 0 then 0 when command = 'undo' then -1 when redoing then 1 else 0 end").cast("bigint")
        outer = running_walk(redoing.withColumn("step", step), ["site_id"], ["t"], F.col("step"), total="s", lowest="s_low")
        outer = staged(outer.withColumn("before", F.expr("s - step - s_low")).withColumn("missed", F.expr("step = -1 and before = 0")).drop("s", "s_low"), "walk")
        cut = outer.groupBy("site_id", "span").agg(F.min(F.expr("if(missed, t, null)")).alias("a"), F.max(F.expr("if(redoing, t, null)")).alias("b")).filter("a < b")
        if not cut.take(1):
            break
        void = outer.withColumn("void", F.col("void") | F.col("missed")).drop("redoing", "step", "before", "missed")
        rows = staged(void, "spans")
    acts = F.expr("case when push then 'push' when step = -1 and before > 0 then 'undo' when redoing then 'redo' end")
    return outer.withColumn("acts", acts).withColumn("pos", F.expr("if(acts = 'undo', before, before + 1)")).drop("redoing", "step", "before", "missed", "void")


def _acts(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (site_id, own, t, k, off) and operations (site_id, own, k, state, last_t, off, ever): ``own`` is the number of the operation's first command."""
    moves = walked.filter("acts is not null").select("site_id", "pos", "t", "acts", "span")
    owned = running(moves, ["site_id", "pos"], ["t"], {"own": ("max", F.expr("if(acts = 'push', t, null)"))})
    owned = staged(owned, "acts")
    last = owned.groupBy("site_id", "own", "pos").agg(F.max(F.struct("t", "acts", "span")).alias("last"))
    forks = walked.filter("fork").select(F.col("site_id").alias("_site"), (F.col("span") - 1).alias("_span"), F.col("t").alias("gone"))
    on = F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("last.span") == F.col("_span")) & (F.col("last.acts") == "undo")
    ended = last.join(forks, on, "left")
    state = F.expr("case when last.acts <> 'undo' then 'applied' when gone is null then 'redoable' else 'discarded' end")
    ops = staged(ended.select("site_id", "own", F.col("pos").alias("k"), state.alias("state"), F.coalesce("gone", "last.t").alias("last_t"), (F.col("last.acts") == "undo").alias("off"), (F.col("last.acts") != "push").alias("ever")), "ops")
    events = owned.filter("acts <> 'push'").select("site_id", "own", "t", F.col("pos").alias("k"), (F.col("acts") == "undo").alias("off"))
    return events.unionByName(ops.filter("state = 'discarded'").select("site_id", "own", F.col("last_t").alias("t"), "k", F.lit(True).alias("off"))), ops


def _restored(log: DataFrame) -> DataFrame:
    """(site_id, own, row) of the rows that each restore lists: those written by the named operation before."""
    asked = log.filter("command = 'restore'").select("site_id", F.col("t").alias("own"), _named("node_id").alias("op"))
    return log.filter("command = 'append'").select("site_id", "op", F.col("t").alias("row")).join(asked, ["site_id", "op"]).filter("row < own").select("site_id", "own", "row")


def _reverting(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks (site_id, node_id, own) of reverts, and the rows of reverted nodes (site_id, node_id, row, own, next): ``next`` is the first revert after the row."""
    asked = staged(log.filter("command = 'revert'").select("site_id", "node_id", F.col("t").alias("own")), "asked")
    rows = log.filter("command = 'append'").join(asked.select("site_id", "node_id").distinct(), ["site_id", "node_id"], "left_semi")
    rows = rows.select("site_id", "node_id", F.col("t").alias("at"), F.col("t").alias("row"), F.col("born").alias("own"), F.lit(None).cast("bigint").alias("mark"))
    marks = asked.select("site_id", "node_id", F.col("own").alias("at"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("own"), F.col("own").alias("mark"))
    ahead = running(rows.unionByName(marks), ["site_id", "node_id"], ["-at"], {"next": ("min", F.col("mark"))})
    return asked, staged(ahead.filter("mark is null").select("site_id", "node_id", "row", "own", "next"), "rows")


def _reverted(asked: DataFrame, rows: DataFrame, events: DataFrame, restored: DataFrame, found: DataFrame | None) -> DataFrame:
    """(site_id, node_id, own, row): the rows that are live when their node is reverted next.

    A row that only its own writing sets on is listed by the next revert.  The
    others are those whose operation, or an operation that lists them, is undone,
    and those that a restore lists: their events are put in order.  ``restored``
    and ``found`` (of the round before) hold what lists them.
    """
    zero = F.lit(0).cast("bigint")
    lists = restored if found is None else restored.unionByName(found)
    mine = rows.join(events, ["site_id", "own"]).filter("t > row").select("site_id", "node_id", "row", "t", F.lit(1).alias("phase"), "k", (~F.col("off")).alias("on"))
    switched = lists.join(events, ["site_id", "own"]).select("site_id", "node_id", "row", "t", F.lit(1).alias("phase"), "k", F.col("off").alias("on"))
    switches = staged(mine.unionByName(switched), "switches")
    touched = staged(switches.select("site_id", "row").unionByName(restored.select("site_id", "row")).distinct(), "touched")
    plain = rows.filter("next is not null").join(touched, ["site_id", "row"], "left_anti").select("site_id", "node_id", F.col("next").alias("own"), "row")
    written = rows.join(touched, ["site_id", "row"], "left_semi").select("site_id", "node_id", "row", F.col("row").alias("t"), F.lit(2).alias("phase"), zero.alias("k"), F.lit(True).alias("on"))
    cleared = lists.join(touched, ["site_id", "row"], "left_semi").select("site_id", "node_id", "row", F.col("own").alias("t"), F.lit(0).alias("phase"), zero.alias("k"), F.lit(False).alias("on"))
    turn = Window.partitionBy("site_id", "row").orderBy("t", "phase", "k")
    spans = written.unionByName(switches).unionByName(cleared).withColumn("until", F.lead("t").over(turn)).filter("on")
    named = spans.select("site_id", "node_id", "t", "row", "until", F.lit(0).alias("mark"), F.lit(None).cast("bigint").alias("own"))
    marks = asked.select("site_id", "node_id", F.col("own").alias("t"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("until"), F.lit(1).alias("mark"), "own")
    # the next revert of the node, from the end; one of the same number comes before what it sets on
    ahead = running(named.unionByName(marks), ["site_id", "node_id"], ["-t", "mark", "row"], {"next": ("min", F.col("own"))}, exclusive=True)
    again = ahead.filter("mark = 0 and next is not null and (until is null or until >= next)").select("site_id", "node_id", F.col("next").alias("own"), "row").distinct()
    return plain.unionByName(again)


def _settled(log: DataFrame, ops: DataFrame, lists: DataFrame) -> DataFrame:
    """(site_id, t, live) of every appended row, by the last event of its operation and of each operation that lists it."""
    key = lambda t, phase, k: F.struct(t.alias("t"), F.lit(phase).alias("phase"), k.alias("k"))
    zero = F.lit(0).cast("bigint")
    rows = log.filter("command = 'append'").select("site_id", F.col("t").alias("row"), F.col("born").alias("own"))
    written = rows.select("site_id", "row", key(F.col("row"), 2, zero).alias("at"), F.lit(True).alias("on"))
    mine = rows.join(ops.filter("ever"), ["site_id", "own"]).filter("last_t > row").select("site_id", "row", key(F.col("last_t"), 1, F.col("k")).alias("at"), (~F.col("off")).alias("on"))
    at = F.when(F.col("ever"), key(F.col("last_t"), 1, F.col("k"))).otherwise(key(F.col("own"), 0, zero))
    listed = lists.join(ops, ["site_id", "own"]).select("site_id", "row", at.alias("at"), (F.col("ever") & F.col("off")).alias("on"))
    return written.unionByName(mine).unionByName(listed).groupBy("site_id", F.col("row").alias("t")).agg(F.max_by("on", "at").alias("live"))


def _print(frame: DataFrame) -> tuple:
    return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))).first())


def replay(commands: DataFrame) -> DataFrame:
    """Final state of every operation and liveness of every row (RESULT_COLUMNS).

    Commands: append (op_group, node), revert (op_group, node), restore
    (op_group; node_id names the operation restored), undo, redo; in order of
    (seq, node_id).  Appends of one op_group are one operation, and later ones join
    it.  A revert of a node without live rows is no operation and gives no row;
    reverts and restores give one row, whose ``live`` is NULL.  A site_id of NULL
    is taken out.
    """
    log = _log(commands.filter("site_id is not null"))
    restored = staged(_restored(log), "restored")
    # dealt once: all walks go along it
    steps = dealt(log.select("site_id", "t", "command", (F.col("t") == F.col("born")).alias("first")), ["site_id"], ["t"])
    reverts = log.filter("command = 'revert'").select("site_id", "t")
    asks = bool(reverts.take(1))
    lists, idle, found, seen = restored, None, None, None
    if asks:
        asked, rows = _reverting(log)
        held = staged(restored.join(rows.select("site_id", "node_id", "row"), ["site_id", "row"]).select("site_id", "node_id", "own", "row"), "restored")
        # to begin with: reverts that come next after no row
        idle = staged(reverts.join(rows.select("site_id", F.col("next").alias("t")).distinct(), ["site_id", "t"], "left_anti"), "idle")
    walked_with = ()
    while True:
        # the walk depends on the idle reverts alone
        if (idles := None if idle is None else _print(idle)) != walked_with:
            walked = _walked(steps, idle)
            events, ops = _acts(walked)
            walked_with = idles
        if not asks:
            break
        found = staged(_reverted(asked, rows, events, held, found), "reverted")
        if (now := _print(found.select("site_id", "own", "row"))) == seen:
            break
        seen = now
        lists = restored.unionByName(found.select("site_id", "own", "row"))
        idle = staged(reverts.join(found.select("site_id", F.col("own").alias("t")).distinct(), ["site_id", "t"], "left_anti"), "idle")
    live = _settled(log, ops, lists)
    states = ops.select("site_id", F.col("own").alias("_own"), F.col("state").alias("op_state"))
    appends = log.filter("command = 'append'").select("site_id", "t", "seq", "command", "op_group", "node_id", F.col("born").alias("_own"))
    pushed = walked.filter("acts = 'push' and command <> 'append'").select("site_id", "t")
    others = log.filter("command in ('revert', 'restore')").join(pushed, ["site_id", "t"], "left_semi").select("site_id", "t", "seq", F.lit("revert").alias("command"), "op_group", "node_id", F.col("t").alias("_own"))
    out = appends.join(live, ["site_id", "t"]).unionByName(others.withColumn("live", F.lit(None).cast("boolean")))
    return out.join(states, ["site_id", "_own"]).select(*RESULT_COLUMNS)


def op_states(replayed: DataFrame) -> DataFrame:
    """One row per operation, with undo and redo depth derivable by counting states."""
    return replayed.groupBy("site_id", "op_group").agg(
        F.min("seq").alias("seq"), F.min("command").alias("command"), F.min("op_state").alias("op_state")
    )


#: Rows given out at a time.
OUT_ROWS = 50_000
STREAM_RESULT = "site_id string, seq long, command string, op_group string, node_id string, op_state string, live boolean"


class ReplayState(StatefulProcessor):
    """Operations and rows of one site, numbered and kept in pages; a batch writes the pages that it touches.

    Live rows of a node are a chain through the rows (``before``, ``after``), rows
    of an operation another one (``next``), and what reverts list lies in one long
    list, so a command costs as much as the rows it switches, however long the log.
    """

    def init(self, handle) -> None:
        # ops: pos, revert, first, last, seq, name, node, state; written: op, node, seq, live, before, after, next
        self.ends = handle.getValueState("ends", "cursor long, height long, ops long, rows long, listed long, names int, nodes int")
        self.states = {name: handle.getMapState(name, "page long", "data string") for name in ("stack", "ops", "written", "listed", "names", "nodes")}

    def _load(self) -> None:
        self.cursor, self.height, ops, rows, listed, names, nodes = self.ends.get() if self.ends.exists() else (0, 0, 0, 0, 0, 0, 0)
        self.stack = Numbered(self.states["stack"], self.height + 1)
        self.ops, self.written, self.listed = Numbered(self.states["ops"], ops), Numbered(self.states["written"], rows), Numbered(self.states["listed"], listed)
        self.names, self.nodes = Named(self.states["names"], names), Named(self.states["nodes"], nodes)
        self.touched: set[int] = set()

    def _save(self) -> None:
        for pages in (self.stack, self.ops, self.written, self.listed, self.names, self.nodes):
            pages.flush()
        self.ends.update((self.cursor, self.height, self.ops.size, self.written.size, self.listed.size, self.names.size, self.nodes.size))

    def _rows(self, o: int) -> list[int]:
        """Rows that an operation wrote, or that a revert lists."""
        _, revert, first, last, *_ = self.ops.get(o)
        if revert:
            return [self.listed.get(j) for j in range(first, last)]
        out = []
        while first is not None:
            out.append(first)
            first = self.written.get(first)[6]
        return out

    def _switch(self, o: int, on: bool, state: str) -> None:
        revert = self.ops.get(o)[1]
        for r in self._rows(o):
            self._live(r, on != revert)
        self.ops.change(o)[7] = state
        self.touched.add(o)

    def _live(self, r: int, live: bool) -> None:
        row = self.written.get(r)
        self.touched.add(row[0])
        if row[3] == live:
            return
        row = self.written.change(r)
        row[3] = live
        if live:
            self._chain(r, row)
            return
        _, node, _, _, before, after, _ = row
        if before is None:
            self.nodes.put(node, after)
        else:
            self.written.change(before)[5] = after
        if after is not None:
            self.written.change(after)[4] = before

    def _chain(self, r: int, row: list) -> None:
        row[4], row[5] = None, self.nodes.get(row[1])
        if row[5] is not None:
            self.written.change(row[5])[4] = r
        self.nodes.put(row[1], r)

    def _fork(self) -> None:
        for pos in range(self.cursor + 1, self.height + 1):
            self._switch(self.stack.get(pos), False, "discarded")
        self.height = self.cursor

    def _push(self, revert: bool, first: int, last: int, row) -> int:
        self.cursor = self.height = self.cursor + 1
        o = self.ops.add([self.cursor, revert, first, last, int(row.seq), row.op_group, row.node_id, "applied"])
        self.stack.put(self.cursor, o)
        self.touched.add(o)
        return o

    def _append(self, row) -> None:
        self._fork()
        r, known = self.written.size, self.names.get(row.op_group)
        if known is None:
            known = self._push(False, r, r, row)
            self.names.put(row.op_group, known)
        else:
            self.written.change(self.ops.get(known)[3])[6] = r
            self.ops.change(known)[3] = r
        entry = [known, row.node_id, int(row.seq), True, None, None, None]
        self.written.add(entry)
        self._chain(r, entry)
        self.touched.add(known)

    def _clear(self, rows: list[int], row) -> None:
        for r in rows:
            self._live(r, False)
        self._fork()
        first = self.listed.size
        for r in rows:
            self.listed.add(r)
        self._push(True, first, self.listed.size, row)

    def _apply(self, row) -> None:
        if row.command == "append":
            self._append(row)
        elif row.command == "revert":
            held, r = [], self.nodes.get(row.node_id)
            while r is not None:
                held.append(r)
                r = self.written.get(r)[5]
            if held:
                self._clear(held, row)
        elif row.command == "restore":
            goal = self.names.get(row.node_id)
            self._clear([] if goal is None else self._rows(goal), row)
        elif row.command == "undo" and self.cursor:
            self._switch(self.stack.get(self.cursor), False, "redoable")
            self.cursor -= 1
        elif row.command == "redo" and self.cursor < self.height:
            self.cursor += 1
            self._switch(self.stack.get(self.cursor), True, "applied")

    def _changes(self, site: str) -> Iterator[tuple]:
        for o in sorted(self.touched):
            _, revert, _, _, seq, name, node, state = self.ops.get(o)
            if revert:
                yield (site, seq, "revert", name, node, state, None)
            else:
                for r in self._rows(o):
                    _, at, of, live, *_ = self.written.get(r)
                    yield (site, of, "append", name, at, state, live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for row in ordered_rows(rows, ["seq", "node_id", "op_group", "command"]):
            self._apply(row)
        changes = self._changes(key[0])
        while out := list(islice(changes, OUT_ROWS)):
            yield frame(out, STREAM_RESULT, lambda x: x.astype({"seq": "int64", "live": "object"}))
        self._save()

    def close(self) -> None:
        pass


def replay_stream(commands: DataFrame) -> DataFrame:
    """Changed operations and rows after each micro-batch (update mode, RESULT_COLUMNS).

    Commands of a site must arrive in order from batch to batch; within a batch
    they are sorted.  Needs the RocksDB state store, which ``runner.run_available``
    sets.
    """
    return commands.select(*COMMAND_COLUMNS).groupBy("site_id").transformWithStateInPandas(ReplayState(), STREAM_RESULT, "Update", "None")
