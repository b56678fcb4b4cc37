"""Browsing answers: positions, pages, statistics, the log of queries, and what a move changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .queries import get, get_any, names, narrowing
from .traversal import cones


def disjuncts(words: list[str]) -> list[list[str]]:
    """A query from its words: terms, with `or` between conjunctions; a dangling `or` is refused."""
    out: list[list[str]] = [[]]
    for i, w in enumerate(words):
        if w != "or":
            out[-1].append(w)
        elif not out[-1] or i + 1 == len(words):
            raise ValueError("`or` needs terms on both sides")
        else:
            out.append([])
    return out


def count(edges: DataFrame, query: list[list[str]]) -> DataFrame:
    """(n): the exact size of an answer."""
    return get_any(edges, query).agg(F.count("*").alias("n"))


def page(answer: DataFrame, most: int | None) -> DataFrame:
    """(name, count, truncated): the first names of an answer, each with the size of the whole and
    whether some are withheld; no cap unless one is given."""
    total = answer.agg(F.count("*").alias("count"))
    first = answer.select("name").orderBy("name") if most is None else answer.select("name").orderBy("name").limit(most)
    shown = F.col("count") > F.lit(most) if most is not None else F.lit(False)
    return first.join(F.broadcast(total)).select("name", "count", shown.alias("truncated"))  # total: one row


def position(edges: DataFrame, terms: list[str]) -> DataFrame:
    """(kind, name, n): the answer's names (here, n 0), what narrows it (refine) with counts, and its size."""
    answer = materialize(get(edges, terms))
    here = answer.select(F.lit("here").alias("kind"), "name", F.lit(0).cast("long").alias("n"))
    refine = narrowing(edges, answer, terms).select(F.lit("refine"), F.col("term"), F.col("n"))
    return here.union(refine).union(answer.agg(F.lit("count").alias("kind"), F.lit("").alias("name"), F.count("*").alias("n")))


def query_log(log: DataFrame, terms: str = "terms") -> DataFrame:
    """(query, n): how often each set of terms was asked, whatever their order or repeats; most first."""
    asked = F.array_join(F.array_sort(F.array_distinct(terms)), " ")
    return log.groupBy(asked.alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query")


def about(edges: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(what, n): names, edges, categories right under the root, leaves, and typed heads."""
    inner = edges.select(F.col("parent").alias("name")).distinct()
    size = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    parts = [size("names", names(edges)), size("edges", edges), size("top", edges.where("parent = '*'").select("child").distinct()), size("leaves", names(edges).join(inner, "name", "left_anti"))]
    parts += [size("heads", kinds)] if kinds is not None else []
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reachable(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, n): how many of the targets (name) lie strictly below each start (term); 0 too."""
    below = cones(edges, starts).join(targets.select("name").distinct(), "name", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return starts.select("term").distinct().join(below, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def under_all(edges: DataFrame, targets: list[str]) -> DataFrame:
    """(name): names strictly below every one of several targets; none asked: everything."""
    return get(edges, targets)


def move_note(before: DataFrame, after: DataFrame, source: str, target: str) -> DataFrame:
    """(what, n): names that left the source's cone, that reached the target's, and that are in both after it."""
    cone = lambda e, t: get(e, [t])
    size = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    was, now, there = materialize(cone(before, source)), materialize(cone(after, source)), materialize(cone(after, target))
    arrived = there.join(cone(before, target), "name", "left_anti")
    return size("departed", was.join(now, "name", "left_anti")).union(size("arrived", arrived)).union(size("contested", now.join(there, "name", "left_semi")))


def vocabulary(edges: DataFrame) -> DataFrame:
    """(name): what describes the graph itself: names one or two steps below `dimension`."""
    first = edges.where("parent = 'dimension'").select(F.col("child").alias("name"))
    return first.union(edges.join(first, edges["parent"] == first["name"], "left_semi").select("child")).distinct()


def shared(edges: DataFrame, other: DataFrame) -> DataFrame:
    """(parent, child): the names that two graphs share, under the root where the other has them there;
    inner edges are not taken over."""
    both = names(edges).join(names(other), "name", "left_semi")
    return other.where("parent = '*'").join(both, F.col("child") == F.col("name"), "left_semi").select("parent", "child")


def get_by_graph(edges: DataFrame, query: DataFrame, low: int = 1) -> DataFrame:
    """(name): names below all the shared leaves of a query graph."""
    inner = query.where("parent <> '*'").select(F.col("parent").alias("name")).distinct()
    leaves = names(query).join(inner, "name", "left_anti").join(names(edges), "name", "left_semi").select(F.col("name").alias("term"))
    total = leaves.agg(F.count("*").alias("total"))
    found = cones(edges, leaves).groupBy("name").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(total), F.col("n") == F.col("total")).where(F.col("total") >= low).select("name")  # total: one row


def node_json(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, json): each name with its sorted parents and its number of descendants."""
    up = edges.groupBy(F.col("child").alias("name")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return up.join(counts, "name").select("name", F.to_json(F.struct("name", "parents", F.col("n").alias("descendant_count"))).alias("json"))


def structure(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, line): every name with its parents, in an order that puts parents first."""
    up = edges.groupBy(F.col("child").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ", ").alias("up"))
    return up.join(levels, "name").select("level", F.concat("name", F.lit(" < "), "up").alias("line")).orderBy("level", "line")
