"""Descendant counts kept up to date by what a batch of edges changes.

A pair (ancestor, descendant) is gained only through an added edge, and lost only through a removed one, so only
ancestors of the batch's parents and descendants of its children are walked, and an ancestor that reached the child
before is left out with everything below it. Leaves with one parent are counted at it, not walked. Pairs are told apart, not summed an edge, so diamonds and overlapping
batches count once. With an EdgeIndex a walk reads only the buckets that it meets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .indexes import EdgeIndex
from .traversal import cones, spread

Near = Callable[[DataFrame], DataFrame]
KEY = ["parent", "child"]


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def _edited(near: Near, gone: DataFrame, more: DataFrame) -> Near:
    return lambda frontier: near(frontier).join(gone, KEY, "left_anti").unionByName(more)


def gained(old: tuple[Near, Near], new: tuple[Near, Near], added: DataFrame) -> DataFrame:
    """(a, d): the pairs of the strict order that the graph `new` has and `old` has not; each graph as its
    (down, up); added: the edges of `new` that `old` lacks."""
    (old_down, old_up), (new_down, new_up) = old, new
    self_ = lambda names, walk: names.select("term", F.col("term").alias("name")).union(walk)
    heads = added.select(F.col("parent").alias("term")).distinct()
    feet = added.select(F.col("child").alias("term")).distinct()
    over = added.join(self_(heads, cones(new_up, heads)), F.col("parent") == F.col("term")).select(F.col("name").alias("a"), F.col("child").alias("c")).distinct()
    known = cones(old_up, feet).select(F.col("name").alias("a"), F.col("term").alias("c"))
    fresh = materialize(over.join(known, ["a", "c"], "left_anti"))  # these reach the child of an added edge for the first time
    feet = materialize(fresh.select(F.col("c").alias("term")).distinct())
    below = materialize(self_(feet, cones(new_down, feet)))
    wanted = materialize(fresh.join(below, F.col("c") == F.col("term")).select("a", F.col("name").alias("d")).distinct())
    # which of them the old graph had: its paths into what lies below, from outside or from within
    both = cones(lambda f: old_down(f).unionByName(new_down(f)).distinct(), feet)
    inside = materialize(both.select("name").union(feet.select(F.col("term").alias("name"))).distinct())
    heads = materialize(fresh.select("a").distinct())
    into = old_up(inside).join(inside.withColumnRenamed("name", "parent"), "parent", "left_semi").select(F.col("child").alias("x"), F.col("parent").alias("y"))
    into = materialize(into)
    outer = into.join(inside.withColumnRenamed("name", "x"), "x", "left_anti")
    doors = outer.select(F.col("x").alias("term")).distinct()
    from_outside = self_(doors, cones(old_up, doors)).join(heads.withColumnRenamed("a", "name"), "name", "left_semi")
    from_outside = outer.join(from_outside, F.col("x") == F.col("term")).select(F.col("name").alias("term"), F.col("y").alias("name"))
    from_within = into.join(heads.withColumnRenamed("a", "x"), "x", "left_semi").select(F.col("x").alias("term"), F.col("y").alias("name"))
    seeds = materialize(from_outside.union(from_within).distinct())
    within = into.join(inside.withColumnRenamed("name", "x"), "x", "left_semi").select(F.col("x").alias("parent"), F.col("y").alias("child"))
    had = seeds.union(spread(materialize(within), seeds)).select(F.col("term").alias("a"), F.col("name").alias("d"))
    return wanted.join(had, ["a", "d"], "left_anti").where("a <> d")


def count_changes(index: EdgeIndex, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(name, delta): by how much each name's number of descendants changes; names that keep theirs are left out.
    Edges that are there already, or not there to be removed, change nothing; an edge both added and removed is left as it is."""
    more, less = added.select(*KEY).where("parent <> child").distinct(), removed.select(*KEY).distinct()
    ends = more.union(less)
    here = materialize(index.down(ends.select(F.col("parent").alias("name"))).join(ends, KEY, "left_semi").distinct())
    gone = materialize(less.join(more, KEY, "left_anti").join(here, KEY, "left_semi"))
    come = materialize(more.join(here, KEY, "left_anti").join(less, KEY, "left_anti"))
    # leaves with one parent that the batch leaves alone are not walked: whoever gains or loses their parent gains or loses them
    named = materialize(ends.select(F.col("parent").alias("name")).union(ends.select("child")).distinct())
    turned = materialize(index.up(named, True).join(named.withColumnRenamed("name", "parent"), "parent", "left_semi"))
    down, up = lambda f: index.down(f, False).unionByName(_turned(turned)), lambda f: index.up(f, False).unionByName(turned)
    before, after = (down, up), (_edited(down, gone, come), _edited(up, _turned(gone), _turned(come)))
    parts = []
    for graphs, edges, sign in (((before, after), come, 1), ((after, before), gone, -1)):
        if edges.isEmpty():
            continue
        pairs = materialize(gained(*graphs, edges))
        ends = materialize(pairs.select(F.col("d").alias("name")).distinct())
        leaves = index.down(ends, True).join(named.withColumnRenamed("name", "child"), "child", "left_anti").groupBy(F.col("parent").alias("d")).agg(F.count("*").alias("more"))
        parts.append(pairs.join(leaves, "d", "left").groupBy(F.col("a").alias("name")).agg((sign * F.sum(1 + F.coalesce("more", F.lit(0)))).alias("delta")))
    if not parts:
        return added.sparkSession.createDataFrame([], "name string, delta long")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("name").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def update_counts(counts: DataFrame, index: EdgeIndex, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(name, n): `counts` after the batch. New names get theirs; a name that no edge holds any more goes."""
    counts, changes = materialize(counts.select("name", "n")), count_changes(index, added, removed)
    new = added.select(F.col("parent").alias("name")).union(added.select("child")).distinct()
    loose = removed.select(F.col("parent").alias("name")).union(removed.select("child")).distinct().join(new, "name", "left_anti")
    held = lambda near: near(loose).join(removed.select(*(KEY if near == index.down else [F.col("child").alias("parent"), F.col("parent").alias("child")])), KEY, "left_anti").select(F.col("parent").alias("name"))
    lost = loose.join(held(index.down), "name", "left_anti").join(held(index.up), "name", "left_anti")
    kept = counts.unionByName(new.join(counts, "name", "left_anti").select("name", F.lit(0).cast("long").alias("n"))).join(lost, "name", "left_anti")
    return kept.join(changes, "name", "left").select("name", (F.col("n") + F.coalesce("delta", F.lit(0))).alias("n"))
