"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a sequence of turns, and each of its prefixes has a
fingerprint: the sum of hashes of (position, role, text), so the fingerprint of
the next shorter prefix is one subtraction away.  Texts are hashed where they are
read and never shuffled.

Compacted nodes are the prefixes at which a conversation ends or conversations
part.  A node of depth e below a parent of depth p is hashed under the prefix of
its path whose length is the two-fattest number in (p, e] (the one divisible by
the highest power of two): its handle.  Conversations are inserted in batches.
Each batch finds the exit nodes of its conversations by a fat binary search,
which probes the handles log2(length) times (``located``), compares the edge of
the exit node, and adds the prefixes beyond it, new ends and the places where
edges are cut, as nodes (``inserted``).  At the end edges are expanded into one
row per prefix (``expanded``).

All tables are slim and written to the shared folder.  A conversation may have
any number of turns: prefixes are rows, never arrays, numbered and summed by
``plans.ordered``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running, with_row_number
from .common import partitions_of, staged, table

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Cumulative shares, out of the last, of conversations in each batch: an eighth first, then the rest.
BATCHES = (1, 8)
FAMILY = 20
#: Ids of one chunk of an end's list.
IDS = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of every turn, numbered from 1 in order of turn, NULL first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("known"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.expr(f"regexp_count(coalesce(cast(text as string), ''), '{WORD}')").alias("words"),
    )
    return staged(with_row_number(slim, ["conv_id"], ["known", "turn", "digest"], "pos").select("conv_id", "pos", "digest", "words"), "turns")


def rebuilt(numbered: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words) of the rebuilt conversations, and (conv_id) of all of them.

    The first h turns come from the first conversation of the family, h = crc32 of the id modulo 4.
    """
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = staged(numbered.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")
    named = convs.select("conv_id", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lead = numbered.filter("pos <= 3").select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    opening = named.filter("h > 0").join(lead, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "words")
    # own turns move up where the family's first conversation is too short
    sizes = convs.select(F.col("conv_id").alias("base"), "n")
    short = named.join(sizes, "base", "left").select("conv_id", (F.col("h") - F.least(F.col("h"), F.coalesce("n", F.lit(0)))).alias("up")).filter("up > 0")
    own = numbered.filter(F.col("pos") > heads).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "words")
    return opening.unionByName(own), convs.select("conv_id")


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, words, fp, before): the fingerprint of each prefix and of the next shorter one (0 for the empty one)."""
    mixed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    half = lambda at: F.conv(F.substring(mixed, at, 11), 16, 10).cast("decimal(14,0)")
    value = (half(1) * F.lit(1 << 44).cast("decimal(14,0)") + half(12)).cast("decimal(28,0)")
    hashed = sequences.select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.col("words").cast("bigint").alias("words"), value.alias("value"))
    summed = running(hashed, ["conv_id"], ["depth"], {"fp": ("sum", F.col("value"))})
    kind = "decimal(38,0)"
    return staged(summed.select("conv_id", "depth", "words", F.col("fp").cast(kind).alias("fp"), (F.col("fp") - F.col("value")).cast(kind).alias("before")), "prefixes")


def fattest(low: str, high: str) -> str:
    """SQL of the number in (low, high] that is divisible by the highest power of two."""
    bits = f"cast(length(bin({low} ^ {high})) - 1 as int)"
    return f"shiftleft(shiftright({high}, {bits}), {bits})"


NODE = ("depth", "fp", "parent_depth", "parent_fp", "conv", "handle", "handle_fp", "start_fp")


def located(batch: DataFrame, paths: DataFrame, everything: DataFrame, trie: DataFrame) -> DataFrame:
    """(conv_id, size, matched) of each conversation of the batch: how many turns it shares with the trie.

    ``batch`` has (conv_id, size); ``paths`` the prefixes of the batch.  The
    search keeps an interval (low, high] of depths; a hit raises low to the
    extent of the node, a miss lowers high below the probe.  A conversation that
    runs through the whole extent may go on along the edge of a child whose handle
    lies beyond its turns; that edge is found by its first turn.
    """
    longest = batch.agg(F.max("size")).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    state = batch.select("conv_id", "size", zero.alias("low"), F.col("size").alias("high"), zero.alias("at"), zero.alias("extent"), zero.cast("decimal(38,0)").alias("extent_fp"), F.lit(None).cast("bigint").alias("via"))
    probe_at = paths.select("conv_id", F.col("depth").alias("probe"), F.col("fp").alias("probe_fp"))
    handles = trie.select(F.col("handle").alias("probe"), F.col("handle_fp").alias("probe_fp"), F.col("depth").alias("found"), F.col("fp").alias("found_fp"), F.col("conv").alias("found_conv"))
    for step in range(int(longest).bit_length()):
        asked = state.withColumn("probe", F.expr(f"if(low < high, {fattest('low', 'high')}, null)")).join(probe_at, ["conv_id", "probe"], "left").join(handles, ["probe", "probe_fp"], "left")
        hit, active = F.col("found").isNotNull(), F.col("probe").isNotNull()
        state = asked.select(
            "conv_id", "size", F.when(hit, F.col("found")).otherwise(F.col("low")).alias("low"), F.when(active & ~hit, F.col("probe") - 1).otherwise(F.col("high")).alias("high"),
            F.when(hit, F.col("probe")).otherwise(F.col("at")).alias("at"), F.when(hit, F.col("found")).otherwise(F.col("extent")).alias("extent"),
            F.when(hit, F.col("found_fp")).otherwise(F.col("extent_fp")).alias("extent_fp"), F.when(hit, F.col("found_conv")).otherwise(F.col("via")).alias("via"),
        )
        if step % 3 == 2:
            state = staged(state, "search")
    state = staged(state, "found")
    through = paths.select("conv_id", F.col("depth").alias("extent"), F.col("fp").alias("extent_fp"), F.lit(True).alias("through"))
    first_turn = paths.select("conv_id", (F.col("depth") - 1).alias("extent"), F.col("fp").alias("start_fp"))
    children = trie.select(F.col("parent_depth").alias("extent"), "start_fp", F.col("depth").alias("child"), F.col("conv").alias("child_conv"))
    whole = state.join(through, ["conv_id", "extent", "extent_fp"], "left").withColumn("through", F.col("through").isNotNull() | (F.col("extent") == 0))
    onward = whole.join(first_turn, ["conv_id", "extent"], "left").withColumn("start_fp", F.when(F.col("through"), F.col("start_fp"))).join(children, ["extent", "start_fp"], "left")
    down = F.col("child").isNotNull()
    state = staged(onward.select(
        "conv_id", "size", F.when(down, F.col("extent") + 1).when(F.col("through"), F.col("extent")).otherwise(F.col("at")).alias("at"),
        F.coalesce("child", "extent").alias("extent"), F.coalesce("child_conv", "via").alias("via"),
    ), "exits")
    # the rest of the exit node's edge, compared with a conversation that runs along it
    edge = state.filter("via is not null and at < least(extent, size)").join(paths, "conv_id").filter("depth > at and depth <= least(extent, size)").select("conv_id", "via", "depth", "fp")
    along = everything.select(F.col("conv_id").alias("via"), "depth", "fp")
    same = edge.join(along, ["via", "depth", "fp"]).groupBy("conv_id").agg(F.count("*").alias("more"))
    return staged(state.join(same, "conv_id", "left").select("conv_id", "size", (F.col("at") + F.coalesce("more", zero)).alias("matched")), "located")


def _with_handles(nodes: DataFrame, everything: DataFrame) -> DataFrame:
    at = nodes.withColumn("handle", F.expr(fattest("parent_depth", "depth")))
    lookup = everything.select(F.col("conv_id").alias("conv"), F.col("depth").alias("handle"), F.col("fp").alias("handle_fp"))
    starts = everything.select(F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("parent_depth"), F.col("fp").alias("start_fp"))
    return at.join(lookup, ["conv", "handle"]).join(starts, ["conv", "parent_depth"]).select(*NODE)


def inserted(trie: DataFrame | None, batch: DataFrame, paths: DataFrame, everything: DataFrame) -> DataFrame:
    """The trie with the conversations of a batch: NODE of each node but the root."""
    zero = F.lit(0).cast("bigint")
    exits = batch.select("conv_id", "size", zero.alias("matched")) if trie is None else located(batch, paths, everything, trie)
    rest = paths.join(exits, "conv_id")
    ends = rest.filter("depth = size").select("depth", "fp", "conv_id")
    cuts = rest.filter("depth = matched and matched < size").select("depth", "fp", "conv_id")
    fresh = rest.filter("depth > matched and depth > 1").groupBy((F.col("depth") - 1).alias("above"), "before", "fp").agg(F.min("conv_id").alias("conv_id"))
    forks = fresh.groupBy(F.col("above").alias("depth"), F.col("before").alias("fp")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    points = ends.unionByName(cuts).unionByName(forks).groupBy("depth", "fp").agg(F.min("conv_id").alias("conv"))
    if trie is not None:
        points = points.join(trie.select("depth", "fp"), ["depth", "fp"], "left_anti")
    points = staged(points, "points")
    # parents of new nodes: the last node before them on the path of their conversation
    known = points.select("depth", "fp") if trie is None else points.select("depth", "fp").unionByName(trie.select("depth", "fp"))
    on_path = paths.join(points.select(F.col("conv").alias("conv_id")).distinct(), "conv_id", "left_semi").join(known, ["depth", "fp"], "left_semi").select("conv_id", "depth", "fp")
    last = running(on_path, ["conv_id"], ["depth"], {"last": ("max", F.struct("depth", "fp"))}, exclusive=True)
    new = last.join(points.withColumnRenamed("conv", "conv_id"), ["conv_id", "depth", "fp"]).select(
        "depth", "fp", F.coalesce("last.depth", zero).alias("parent_depth"), F.coalesce("last.fp", F.lit(0).cast("decimal(38,0)")).alias("parent_fp"), F.col("conv_id").alias("conv")
    )
    new = staged(_with_handles(new, everything), "new")
    if trie is None:
        return new
    # edges that new nodes cut
    inner = trie.filter("depth > parent_depth + 1").select(F.col("conv").alias("conv_id"), F.col("depth").alias("bottom"), F.col("fp").alias("bottom_fp"), "parent_depth")
    cut = (
        everything.select("conv_id", "depth", "fp").join(points.select("depth", "fp"), ["depth", "fp"], "left_semi").join(inner, "conv_id").filter("depth > parent_depth and depth < bottom")
        .groupBy(F.col("bottom").alias("depth"), F.col("bottom_fp").alias("fp")).agg(F.max(F.struct("depth", "fp")).alias("cut"))
    )
    cut = staged(cut, "cut")
    kept = trie.join(cut.select("depth", "fp"), ["depth", "fp"], "left_anti")
    changed = trie.join(cut, ["depth", "fp"]).select("depth", "fp", F.col("cut.depth").alias("parent_depth"), F.col("cut.fp").alias("parent_fp"), "conv")
    return staged(kept.select(*NODE).unionByName(_with_handles(changed, everything)).unionByName(new), "trie")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the ids (conv_id) that end at each node, ascending and comma-joined.

    SHA-256 reads its input in order, so the ids of one node meet in one task in
    the end; they arrive as joined runs and are streamed, never held at once.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, ids = rows.column(0), rows.column(1).to_numpy().tolist()
            change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            cuts = sorted({*change.tolist(), *range(0, len(ids), IDS), len(ids)})
            runs = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([a for a, _ in runs], pa.int64())), pa.array([ids[a] for a, _ in runs], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in runs])], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for rows in batches:
            for node, ids in zip(rows.column(0).to_pylist(), rows.column(2), strict=True):
                if node == current:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = node, hashlib.sha256()
                state.update(ids.as_buffer())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
                done = []
        if state is not None:
            done.append((current, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])

    named = ends.select(F.concat_ws(":", F.col("depth").cast("string"), F.col("fp").cast("string")).alias("node"), "conv_id")
    n = partitions_of(ends)
    runs = named.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, "node string, first bigint, ids string")
    hashed = runs.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digest, "node string, ends_sha256 string")
    part = F.split("node", ":")
    return hashed.select(part[0].cast("bigint").alias("depth"), part[1].cast("decimal(38,0)").alias("fp"), "ends_sha256")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expanded(trie: DataFrame, paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per prefix (COLUMNS): edges of the trie expanded, with the totals of their subtrees.

    Members of a node are counted on their paths.  What a subtree saves is summed
    without walking it: every node is credited to its smallest member, each path
    adds up its credits from the bottom, and a node sums the paths through it.
    """
    zero = F.lit(0).cast("bigint")
    at = trie.select("depth", "fp", F.struct("depth", "fp").alias("mark"))
    # each prefix belongs to the next node below it on its path
    owned = running(paths.select("conv_id", "depth", "fp", "words").join(at, ["depth", "fp"], "left"), ["conv_id"], ["-depth"], {"node": ("min", F.col("mark"))})
    owned = staged(owned.select("conv_id", "depth", "words", F.col("node.depth").alias("bottom"), F.col("node.fp").alias("bottom_fp"), F.col("mark").isNotNull().alias("is_bottom")), "owned")
    members = owned.filter("is_bottom").groupBy("bottom", "bottom_fp").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    children = trie.groupBy(F.col("parent_depth").alias("bottom"), F.col("parent_fp").alias("bottom_fp")).agg(F.count("*").alias("children"))
    sized = staged(members.join(children, ["bottom", "bottom_fp"], "left"), "members")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    parents = sized.select(F.col("bottom").alias("parent_depth"), F.col("bottom_fp").alias("parent_fp"), F.col("least").alias("parent_least"))
    edges = trie.select(F.col("depth").alias("bottom"), F.col("fp").alias("bottom_fp"), "parent_depth", "parent_fp").join(parents, ["parent_depth", "parent_fp"], "left").drop("parent_fp")
    nodes = staged(sized.join(edges, ["bottom", "bottom_fp"]), "nodes")
    mine = owned.join(nodes.select("bottom", "bottom_fp", "n", "least", "children"), ["bottom", "bottom_fp"])
    mine = mine.withColumn("own", F.col("conv_id") == F.col("least")).withColumn("credit", F.expr("if(own, words * (n - 1), 0)")).withColumn("leaf", F.expr("if(own and is_bottom and children is null, 1, 0)"))
    below = running(mine, ["conv_id"], ["-depth"], {"credits": ("sum", F.col("credit")), "leaves": ("sum", F.col("leaf"))})
    below = staged(below, "credits")
    sums = below.filter("is_bottom").groupBy("bottom", "bottom_fp").agg(F.sum(F.expr("if(own, 0, credits - credit)")).alias("others"), F.sum("leaves").alias("n_leaves"))
    sizes = convs.join(paths.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("end")), "conv_id", "left")
    ends = sizes.select("conv_id", F.coalesce("end.depth", zero).alias("depth"), F.coalesce("end.fp", F.lit(0).cast("decimal(38,0)")).alias("fp"))
    digests = staged(ends_digests(ends), "ends")
    nothing = F.lit(hashlib.sha256().hexdigest())
    rows = (
        below.filter("own").select("conv_id", "depth", "bottom", "bottom_fp", "n", "credits", "is_bottom")
        .join(nodes.select("bottom", "bottom_fp", "children", "parent_depth", "parent_least"), ["bottom", "bottom_fp"])
        .join(sums, ["bottom", "bottom_fp"])
        .join(digests.select(F.col("depth").alias("bottom"), F.col("fp").alias("bottom_fp"), "ends_sha256"), ["bottom", "bottom_fp"], "left")
    )
    first = whole.first()
    inner = rows.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("parent_depth") + 1, F.col("conv_id")).when(F.col("parent_depth") == 0, F.lit(first.least).cast("bigint")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.expr("if(is_bottom, coalesce(children, 0), 1)").cast("bigint").alias("n_children"), "n_leaves",
        (F.col("credits") + F.col("others")).alias("saved_tokens"), F.when(F.col("is_bottom"), F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    # the root takes in everything: one row, from four totals
    total = below.agg(F.sum("credit").alias("saved"), F.sum("leaf").alias("leaves")).first()
    tops = trie.filter("parent_depth = 0").count()
    empty = digests.filter("depth = 0").first()
    number = lambda x: F.lit(x).cast("bigint")
    root = whole.filter("n > 0").select(
        F.col("least").alias("conv_id"), zero.alias("depth"), number(None).alias("parent_conv_id"), F.col("n").alias("n_convs"), number(tops).alias("n_children"),
        number(total.leaves or 1).alias("n_leaves"), number(total.saved or 0).alias("saved_tokens"), (F.lit(empty.ends_sha256) if empty else nothing).alias("ends_sha256"),
    )
    return inner.unionByName(root)


def prefix_trie(conversations: DataFrame, batches: Sequence[int] = BATCHES, family: int = FAMILY) -> DataFrame:
    """COLUMNS of every prefix of the rebuilt conversations, the empty one included.

    Rows without a conv_id take no part.  Turns are ordered by turn, NULL first;
    turns of one number are ordered by a digest of role and text, and repeated
    rows are turns of their own.  NULL roles and texts are empty.  Texts are
    hashed and counted whole.  Other columns are not read.  No conversations give
    no rows, not even the root.
    """
    sequences, convs = rebuilt(turns(conversations), family)
    paths = prefixes(sequences)
    sized = paths.groupBy("conv_id").agg(F.max("depth").alias("size"))
    share = F.pmod(F.xxhash64("conv_id"), F.lit(batches[-1]))
    trie, low = None, 0
    for high in batches:
        chosen = (share >= low) & (share < high)
        mine = staged(sized.filter(chosen), "batch")
        trie, low = inserted(trie, mine, paths.filter(chosen), paths), high
    return expanded(trie, paths, convs)


def op11_zfast_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
OP11_SQL = rf"""
with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, md5(cast(length(role) as varchar) || ':' || role || text)) as pos
   from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
 c as (select conv_id, {_CRC} % 4 as h, conv_id - conv_id % 20 as base from (select distinct conv_id from t)),
 s as (select c.conv_id, 0 as part, t.pos, role, text from c join t on t.conv_id = c.base and t.pos <= c.h
   union all select c.conv_id, 1 as part, t.pos, role, text from c join t on t.conv_id = c.conv_id and t.pos > c.h),
 r as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, role, text from s),
 p as (select conv_id, depth, list((role, text)) over (partition by conv_id order by depth) as seq,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r
   union all select conv_id, 0, [], 0 from c),
 l as (select conv_id, max(depth) as size from p group by conv_id),
 n as (select seq, depth, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = depth), '') as ids from p join l using (conv_id) group by seq, depth),
 up as (select *, case when depth > 0 then list_slice(seq, 1, depth - 1) end as parent from n),
 kids as (select parent as seq, count(*) as n_children from up where depth > 0 group by parent),
 f as (select up.*, coalesce(n_children, 0) as n_children from up left join kids using (seq)),
 above as (select unnest(list_transform(range(0, depth + 1), lambda d: list_slice(seq, 1, d))) as seq, n_children, (n_convs - 1) * words as saved from f),
 sub as (select seq, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from above group by seq)
select f.conv_id, f.depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(f.ids) as ends_sha256
from f join sub using (seq) left join f q on q.seq = f.parent"""
