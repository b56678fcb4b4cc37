"""Changes of a graph as batches: placing, contraction, cone removal, moves, and parts of a graph.

Each takes and gives edges (parent, child). A change is one set operation over all its names and, where
paths may have become redundant, one reduction; nothing is done name by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import ROOT
from ..session import materialize
from .canonical import reduce_edges
from .queries import get, names
from .traversal import ancestors_of, closure, cones


def _both_ends(edges: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Edges whose two ends both pass a semi or anti join with `chosen` (name)."""
    for end in ("parent", "child"):
        edges = edges.join(chosen.select(F.col("name").alias(end)), end, how)
    return edges.select("parent", "child")


def _rooted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """`edges` and an edge from the root to every member (name) that has no parent in them."""
    loose = members.where(F.col("name") != ROOT).join(edges.select(F.col("child").alias("name")), "name", "left_anti")
    return edges.unionByName(loose.select(F.lit(ROOT).alias("parent"), F.col("name").alias("child")).distinct())


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """`edges` without the edges of `gone` (parent, child); one that is not there is refused (ValueError).
    A name that loses its last parent goes under the root."""
    key = ["parent", "child"]
    absent = gone.join(edges, key, "left_anti").limit(5).collect()  # named in the message
    if absent:
        raise ValueError("no such edge: " + ", ".join(f"{r['parent']} > {r['child']}" for r in absent))
    left = edges.select(*key).join(gone, key, "left_anti")
    orphans = gone.select("child").distinct().join(left, "child", "left_anti")
    return left.unionByName(orphans.select(F.lit(ROOT).alias("parent"), "child"))


def put(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """`edges` with the batch's claims (parent, child), reduced. A parent that is new goes under the
    root; a claim that closes a cycle is refused (ValueError); claims already implied change nothing."""
    both = edges.select("parent", "child").unionByName(batch.select("parent", "child").where("parent <> child")).distinct()
    both = materialize(_rooted(both, both.select(F.col("parent").alias("name"))))
    return reduce_edges(both)


def bridge(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """`edges` without the names of `gone` (name), and an edge for each path whose inner names all go; not reduced."""
    gone = materialize(gone.where(F.col("name") != ROOT).select("name").distinct())
    here = gone.select(F.col("name").alias("child"))
    frontier = edges.join(here, "child", "left_semi").join(gone.select(F.col("name").alias("parent")), "parent", "left_anti").select("parent", "child")
    found, bridges = None, None
    while True:
        frontier = materialize(frontier if found is None else frontier.join(found, ["parent", "child"], "left_anti"))
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
        beyond = frontier.withColumnRenamed("child", "mid").join(edges.withColumnRenamed("parent", "mid"), "mid").select("parent", "child").distinct()
        out = beyond.join(here, "child", "left_anti").select("parent", "child")
        bridges = out if bridges is None else bridges.unionByName(out)
        frontier = beyond.join(here, "child", "left_semi").select("parent", "child")
    kept = _both_ends(edges, gone, "left_anti")
    return kept if bridges is None else kept.unionByName(bridges).distinct()


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """`edges` without the names of `gone` (name): every path through them is contracted, so what was
    below their parents stays below them. The order of names does not matter; unknown ones are ignored."""
    return reduce_edges(materialize(bridge(edges, gone)))


def cone_removal_plan(edges: DataFrame, *targets: str) -> DataFrame:
    """(name): the targets and what lies below them and is not reachable from the root otherwise.

    A name goes just when all its parents go; on a rooted graph these are the names that one
    traversal from the root, never entering a target, does not reach."""
    session = edges.sparkSession
    aims = session.createDataFrame([(t,) for t in sorted(set(targets) - {ROOT})], "name string")
    cone = cones(edges, aims.select(F.col("name").alias("term"))).select("name").unionByName(aims.join(names(edges), "name", "left_semi")).distinct()
    open_edges = edges.join(aims.select(F.col("name").alias("child")), "child", "left_anti").select("parent", "child")
    reached = cones(open_edges, session.createDataFrame([(ROOT,)], "term string")).select("name")
    return cone.join(reached, "name", "left_anti")


def remove_cone(edges: DataFrame, *targets: str) -> DataFrame:
    """`edges` without the planned names; survivors are detached from them, not reattached."""
    return _both_ends(edges, materialize(cone_removal_plan(edges, *targets)), "left_anti")


def reclassify(edges: DataFrame, moved: DataFrame, to: list[str], from_: list[str] | None = None) -> DataFrame:
    """`edges` with the names of `moved` (name) under `to` and no longer under `from_` (None: any
    other parent). Nothing is orphaned: a name left without a parent goes under the root."""
    moved = moved.select(F.col("name").alias("child")).distinct()
    mine = edges.join(moved, "child", "left_semi").select("parent", "child")
    old = mine if from_ is None else mine.where(F.col("parent").isin(from_))
    new = moved.select(F.explode(F.array(*map(F.lit, to)).cast("array<string>")).alias("parent"), "child").where("parent <> child")
    rest = edges.select("parent", "child").join(old.join(new, ["parent", "child"], "left_anti"), ["parent", "child"], "left_anti")
    return put(_rooted(rest, names(edges)), new)


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among `chosen` (name); the root counts where its edge is real."""
    return _both_ends(edges, chosen.select("name").unionByName(edges.sparkSession.createDataFrame([(ROOT,)], "name string")).distinct(), "left_semi")


def excerpt(edges: DataFrame, answer: DataFrame, context: bool = False) -> DataFrame:
    """The graph of an answer (name): its edges, what has no parent in it under the root; with
    `context` also everything above it."""
    chosen = answer.select("name").distinct()
    if context:
        chosen = materialize(chosen.unionByName(ancestors_of(edges, chosen.select(F.col("name").alias("term"))).select("name")).distinct())
    return _rooted(induced(edges, chosen), chosen)


def copy_below(edges: DataFrame, *seeds: str) -> DataFrame:
    """The seeds and all that lies below them, with the edges among them and no root edges."""
    starts = edges.sparkSession.createDataFrame([(s,) for s in seeds], "name string")
    chosen = cones(edges, starts.select(F.col("name").alias("term"))).select("name").unionByName(starts).distinct()
    return _both_ends(edges, materialize(chosen), "left_semi")


def prune_to_common(edges: DataFrame, *terms: str) -> DataFrame:
    """The terms and what lies below all of them; everything else is contracted."""
    keep = get(edges, list(terms)).unionByName(edges.sparkSession.createDataFrame([(t,) for t in terms], "name string")).distinct()
    return remove(edges, names(edges).join(keep, "name", "left_anti"))
