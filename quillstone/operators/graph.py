"""Graphs as edge tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import ensure_checkpoint_dir


def ancestors(edges: DataFrame) -> DataFrame:
    """``node, ancestor, depth``: the transitive closure of ``edges(node, parent)`` with the longest path to each ancestor.

    Paths are doubled: each round joins those found with themselves, so a graph of depth d takes about log2(d) rounds. A node
    that turns out to be its own ancestor lies on a cycle, which is an error; see ``on_cycles``.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    found = edges.select("node", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1).cast("long")).checkpoint()
    size = lambda d: d.agg(F.count("*"), F.sum("depth"), F.count_if(F.col("node") == F.col("ancestor"))).first()
    before = size(found)
    while True:
        if before[2]:
            raise ValueError("the graph has a cycle")
        longer = found.join(found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more")), "ancestor").select(
            "node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = found.unionByName(longer).groupBy("node", "ancestor").agg(F.max("depth").alias("depth")).checkpoint()
        now = size(found)
        if now == before:
            return found.select("node", "ancestor", F.col("depth").cast("int").alias("depth"))
        before = now


def layers(edges: DataFrame) -> DataFrame:
    """``node, layer``: nodes without a parent are in layer 0, others one below the deepest of their parents."""
    deep = ancestors(edges).groupBy("node").agg(F.max("depth").alias("layer"))
    every = edges.select("node").unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    return every.join(deep, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))


#: Rounds in which leaves and roots are peeled off before what is left is closed transitively.
PEELINGS = 8


def on_cycles(edges: DataFrame) -> DataFrame:
    """``node``: nodes on a cycle or on a path from one cycle to another.

    Leaves and roots are peeled off first, which disposes of most graphs. What is left after ``PEELINGS`` rounds is closed
    transitively by doubling: a node stays if it reaches a node that reaches itself and is reached by such a one.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    rest = edges.select("node", "parent").distinct().checkpoint()
    count = rest.count()
    for _ in range(PEELINGS):
        inner = rest.join(rest.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
        rest = inner.join(inner.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent").checkpoint()
        left = rest.count()
        if left in (0, count):
            return rest.select("node").distinct()
        count = left
    reach, before = rest, -1
    while count != before:
        before = count
        reach = reach.unionByName(reach.join(reach.select(F.col("node").alias("parent"), F.col("parent").alias("far")), "parent").select(
            "node", F.col("far").alias("parent"))).distinct().checkpoint()
        count = reach.count()
    own = reach.where("node = parent").select("node")
    up = reach.join(own.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
    down = reach.join(own, "node", "left_semi").select(F.col("parent").alias("node"))
    return up.distinct().join(down.distinct(), "node", "left_semi")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node, component``: connected components of ``edges(a, b)``, named by their smallest node.

    Large-star and small-star rounds: nodes of a component are linked to ever smaller ones until all hang on the smallest,
    which takes about the square of the logarithm of its size. Each round is a checkpoint; rounds end when nothing changes, or
    with an error after ``most`` of them. Neighbourhoods are reduced by minima, never collected, so that a node with very many
    neighbours costs no task more than its share.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()

    def star(links: DataFrame, large: bool) -> DataFrame:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(
            F.col("v").alias("u"), F.col("u").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = sides.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")).select("v", "m") if large else joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return moved.select(F.least("v", "m").alias("u"), F.greatest("v", "m").alias("v")).where("u <> v").distinct()

    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    for _ in itertools.count() if most is None else range(most):
        both = star(star(both, True), False).checkpoint()
        now = sign(both)
        if now == before:
            break
        before = now
    else:
        raise ValueError(f"components still change after {most} rounds")
    own = both.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
