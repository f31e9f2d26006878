"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and cycles.

Leaves are peeled until only cycles are left; the members of cycles are cut from their parents, so that the rest is
a forest. Every tree becomes an Euler tour (enter and exit of each node), a linked list that is ranked by pointer
doubling, in a number of joins logarithmic in its length. Suffix sums along the list give entry and exit positions
and depths. Paths come from scanning the tour in blocks of bounded size, each begun with the nodes still open there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.session import Scratch

#: Children of one parent that are ordered together; a parent with more has its children spread over buckets.
CHILDREN_PER_BUCKET = 50_000
#: Tour positions of one block of the path scan.
BLOCK = 20_000
#: Tour events that are contracted together.
PART = 1_000_000
#: Rounds of peeling before residual chains are shortened by pointer doubling.
PEEL_ROUNDS = 12


def _nodes(edges: DataFrame) -> DataFrame:
    stated = edges.where("node is not null").groupBy("node").agg(
        F.min("parent").alias("parent"), (F.min("parent") != F.max("parent")).alias("conflict"))
    named = edges.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    return (stated.unionByName(named.select("node", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("conflict")))
            .groupBy("node").agg(F.min("parent").alias("parent"), F.coalesce(F.max("conflict"), F.lit(False)).alias("conflict")))


def _cycle_members(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Nodes that lie on a cycle. edges: nid, pid (both not null)."""
    left = keep.write(edges.select("nid", "pid"))
    n = left.count()
    for _ in range(PEEL_ROUNDS):
        if not n:
            break
        after = keep.write(left.join(left.select(F.col("pid").alias("nid")).distinct(), "nid", "left_semi"))
        m = after.count()
        keep.drop(left)
        left = after
        if m == n:  # every node has a child: only cycles are left
            return left.select("nid")
        n = m
    span = 1
    while n and span <= n:  # residual chains: the ancestor n steps up exists only below or on a cycle, and lies on it
        up = left.select(F.col("nid").alias("pid"), F.col("pid").alias("up"))
        after = keep.write(left.join(up, "pid").select("nid", F.col("up").alias("pid")))
        keep.drop(left)
        left, span = after, span * 2
    return left.select(F.col("pid").alias("nid")).distinct()


def _tour(forest: DataFrame) -> DataFrame:
    """Successor of every tour event. forest: nid, pid. An event is nid * 2 for enter, + 1 for exit."""
    kids = forest.where("pid is not null")
    many = kids.groupBy("pid").agg(F.count("*").alias("n")).where(F.col("n") > CHILDREN_PER_BUCKET)
    kids = kids.join(many, "pid", "left").withColumn(
        "bucket", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("nid"), F.ceil(F.col("n") / CHILDREN_PER_BUCKET) * 2)).otherwise(0))
    kids = kids.withColumn("next", F.lead("nid").over(Window.partitionBy("pid", "bucket").orderBy("nid")))
    firsts = kids.groupBy("pid", "bucket").agg(F.min("nid").alias("first"), F.max("nid").alias("last"))
    firsts = firsts.withColumn("follow", F.lead("first").over(Window.partitionBy("pid").orderBy("bucket")))
    kids = (kids.join(firsts.select(F.col("last").alias("nid"), "follow"), "nid", "left")
            .select("nid", F.coalesce("next", "follow").alias("sibling")))
    first_child = firsts.groupBy("pid").agg(F.min_by("first", "bucket").alias("child")).withColumnRenamed("pid", "nid")
    all_ = forest.join(first_child, "nid", "left").join(kids, "nid", "left")
    enter = F.struct((F.col("nid") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("nid") * 2 + 1).alias("next"), F.lit(1).alias("step"))
    leave = F.struct((F.col("nid") * 2 + 1).alias("e"), F.coalesce(F.col("sibling") * 2, F.col("pid") * 2 + 1).alias("next"), F.lit(-1).alias("step"))
    return (all_.select(F.inline(F.array(enter, leave)))
            .select("e", "next", F.lit(1).cast("long").alias("count"), F.col("step").cast("long").alias("open"), F.col("e").alias("tail")))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointers of every event past those that stand in the same part of the table, by doubling over arrays; at most PART rows at a time."""

    def ranked(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        e, count, open_, tail = (t.column(c).to_numpy() for c in ("e", "count", "open", "tail"))
        following = t.column("next").fill_null(-1).to_numpy()
        order = np.argsort(e)
        e, following, count, open_, tail = e[order], following[order], count[order].copy(), open_[order].copy(), tail[order].copy()
        last = len(e)
        at = np.minimum(np.searchsorted(e, following), last - 1)
        at = np.where(e[at] == following, at, last)  # the row of the next event, or none here
        nexts = following.copy()
        while (moving := np.flatnonzero(at < last)).size:
            to = at[moving]
            count[moving], open_[moving] = count[moving] + count[to], open_[moving] + open_[to]
            tail[moving], nexts[moving], at[moving] = tail[to], nexts[to], at[to]
        end = pa.array(nexts, pa.int64(), mask=nexts < 0)
        return pa.RecordBatch.from_arrays([pa.array(e), end, pa.array(count), pa.array(open_), pa.array(tail)], names=["e", "next", "count", "open", "tail"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= PART:
            yield ranked(held)
            held = []
    if held:
        yield ranked(held)


def _rank(tour: DataFrame, keep: Scratch) -> DataFrame:
    """Suffix counts and sums of every event by pointer doubling, with the last event of its list.

    Each part of the table is contracted first, so that what lists hold within a part needs no join.
    """
    cur = keep.write(keep.write(tour).mapInArrow(_contract, "e long, next long, count long, open long, tail long"))

    def double(a: DataFrame) -> DataFrame:
        b = a.select(F.col("e").alias("next"), F.col("next").alias("n2"), F.col("count").alias("c2"), F.col("open").alias("o2"), F.col("tail").alias("t2"))
        return a.join(b, "next", "left").select(
            "e", F.col("n2").alias("next"), (F.col("count") + F.coalesce("c2", F.lit(0))).alias("count"),
            (F.col("open") + F.coalesce("o2", F.lit(0))).alias("open"), F.coalesce("t2", "tail").alias("tail"))

    while cur.where("next is not null").limit(1).count():
        after = keep.write(double(double(cur)))
        keep.drop(cur)
        cur = after
    return cur


def _scan_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree, block and entry; a stack of open nodes gives the path of every own row."""
    stack: list[tuple[int, str]] = []
    at = None
    for b in batches:
        ids, paths = [], []
        for nid, root, block, start, end, name, own in zip(*(b.column(c).to_pylist() for c in ("nid", "root", "block", "tour_in", "tour_out", "node", "own"))):
            if (root, block) != at:
                stack, at = [], (root, block)
            while stack and stack[-1][0] < start:
                stack.pop()
            stack.append((end, name))
            if own:
                ids.append(nid)
                paths.append([n for _, n in stack])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["nid", "path"])


def hierarchy(edges: DataFrame) -> DataFrame:
    """The full hierarchy of parent-child rows.

    edges: ``node`` and ``parent`` (strings, parent null for a root); other columns are ignored, repeated rows count
    once, rows with a null node only name their parent. A node named only as a parent is a root. Of several parents
    stated for a node the least by code point holds and ``conflict`` is true. An empty table gives an empty result.

    Result, one row per node: ``node, parent, rooted, conflict, on_cycle, root, depth`` (1 for a root), ``path`` (root
    first), ``tour_in, tour_out`` (u is an ancestor of v or v itself if they share ``root`` and u.tour_in <= v.tour_in
    and v.tour_out <= u.tour_out) and ``descendants`` (their number). Nodes that never reach a root have
    ``rooted`` false and null in depth, root, path, tour_in, tour_out and descendants.
    """
    spark = edges.sparkSession
    keep = Scratch(spark, "hierarchy")
    nodes = keep.write(_nodes(edges.select(F.col("node").cast("string"), F.col("parent").cast("string"))).withColumn("nid", F.monotonically_increasing_id()))
    linked = keep.write(nodes.join(nodes.select(F.col("node").alias("parent"), F.col("nid").alias("pid")), "parent", "left")
                        .select("nid", "pid", "node", "parent", "conflict"))
    cyclic = keep.write(_cycle_members(linked.where("pid is not null"), keep).withColumn("on_cycle", F.lit(True)))
    forest = keep.write(linked.join(cyclic, "nid", "left").withColumn("up", F.when(F.col("on_cycle").isNull(), F.col("pid"))))
    ranked = _rank(_tour(forest.select("nid", F.col("up").alias("pid"))), keep)
    # enter and exit of a node in one row
    both = ranked.groupBy(F.shiftright("e", 1).alias("nid")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.col("count"))).alias("c_in"), F.max(F.when(F.col("e") % 2 == 1, F.col("count"))).alias("c_out"),
        F.max(F.when(F.col("e") % 2 == 0, 1 - F.col("open"))).alias("depth"), F.shiftright(F.max("tail"), 1).alias("root_nid"))
    heads = both.where("nid = root_nid").select("root_nid", F.col("c_in").alias("length"))
    root_names = forest.where("up is null").select(F.col("nid").alias("root_nid"), F.col("node").alias("root"), F.col("on_cycle").alias("root_on_cycle"))
    placed = keep.write(
        both.join(heads.join(root_names, "root_nid"), "root_nid").join(forest.select("nid", "node", "parent", "conflict", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")), "nid")
        .select("nid", "node", "parent", "conflict", "on_cycle", F.col("root_on_cycle").isNull().alias("rooted"), "root_nid", "root", F.col("depth").cast("int").alias("depth"),
                (F.col("length") - F.col("c_in")).alias("tour_in"), (F.col("length") - F.col("c_out")).alias("tour_out")))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    rows = placed.where("rooted").select("nid", F.col("root_nid").alias("root"), "tour_in", "tour_out", "node")
    own = rows.withColumn("block", block("tour_in")).withColumn("own", F.lit(True))
    open_ = (rows.where(block("tour_out") > block("tour_in"))
             .withColumn("block", F.explode(F.sequence(block("tour_in") + 1, block("tour_out")))).withColumn("own", F.lit(False)))
    paths = (own.unionByName(open_).repartition("root", "block").sortWithinPartitions("root", "block", "tour_in")
             .mapInArrow(_scan_paths, T.StructType([T.StructField("nid", T.LongType()), T.StructField("path", T.ArrayType(T.StringType()))])))
    # written, so that its readers plan from its size and the temporary tables can go
    out = keep.write(placed.join(paths, "nid", "left").select(
        "node", "parent", "rooted", "conflict", "on_cycle",
        *(F.when(F.col("rooted"), F.col(c)).alias(c) for c in ("root", "depth", "path", "tour_in", "tour_out")),
        F.when(F.col("rooted"), ((F.col("tour_out") - F.col("tour_in") - 1) / 2).cast("long")).alias("descendants")))
    for t in (nodes, linked, cyclic, forest, ranked, placed):
        keep.drop(t)
    return out


def closure(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a ``hierarchy`` result, distance 1 or more; the rows of the result itself.

    As many rows as the depths less one add up to. Nodes that never reach a root have no rows.
    """
    return (tree.where("rooted and depth > 1")
            .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("p", "ancestor"))
            .where("p < depth - 1").select("ancestor", "descendant", (F.col("depth") - 1 - F.col("p")).cast("int").alias("distance")))
