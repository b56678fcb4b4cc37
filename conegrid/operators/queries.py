"""Conjunction, union, subsumption and browsing over cones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traversal import ancestors_of, cones, descendants


def names(edges: DataFrame) -> DataFrame:
    """All names but the root."""
    return edges.select(F.col("child").alias("name")).distinct()


def get(edges: DataFrame, terms: list[str]) -> DataFrame:
    """(name) below all terms; no terms: everything. One traversal carries all terms."""
    terms = sorted(set(terms) - {"*"})
    if not terms:
        return names(edges)
    return descendants(edges, *terms).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("name")


def absorb(query: list[list[str]]) -> list[list[str]]:
    """Drop conjunctions that another one already contains."""
    sets = sorted({frozenset(q) for q in query}, key=lambda q: (len(q), sorted(q)))
    kept: list[frozenset] = []
    for q in sets:
        if not any(k <= q for k in kept):
            kept.append(q)
    return [sorted(q) for q in kept]


def get_any(edges: DataFrame, query: list[list[str]]) -> DataFrame:
    """(name) in any of the conjunctions; none: nothing. All distinct terms are walked once."""
    query = absorb(query)
    if not query:
        return names(edges).limit(0)
    if [] in query:
        return names(edges)
    found = descendants(edges, *sorted({t for q in query for t in q})).groupBy("name").agg(F.collect_set("term").alias("terms"))
    hit = F.lit(False)
    for q in query:
        hit = hit | (F.size(F.array_intersect("terms", F.array(*map(F.lit, q)))) == len(q))
    return found.where(hit).select("name")


def is_below(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sub, sup, below) of (sub, sup): reflexive on known names, false for unknown ones; everything
    known is below the root. Pairs that need no walk are left out of it; it goes down from the other
    sups or up from their subs, whichever are fewer."""
    asked = pairs.where("sub <> sup AND sup <> '*'")
    subs, sups = asked.agg(F.countDistinct("sub"), F.countDistinct("sup")).first()
    known = edges.select(F.col("parent").alias("name")).unionAll(edges.select(F.col("child").alias("name"))).distinct()
    if sups <= subs:
        cone = cones(edges, asked.select(F.col("sup").alias("term"))).select(F.col("term").alias("sup"), F.col("name").alias("sub"), F.lit(True).alias("_in"))
    else:
        cone = ancestors_of(edges, asked.select(F.col("sub").alias("term"))).select(F.col("name").alias("sup"), F.col("term").alias("sub"), F.lit(True).alias("_in"))
    found = pairs.join(cone, ["sub", "sup"], "left").join(known.select(F.col("name").alias("sub"), F.lit(True).alias("_known")), "sub", "left")
    return found.select("sub", "sup", (F.coalesce("_in", F.lit(False)) | (((F.col("sub") == F.col("sup")) | (F.col("sup") == "*")) & F.col("_known").isNotNull())).alias("below"))


def facets(edges: DataFrame, members: DataFrame, categories: DataFrame) -> DataFrame:
    """(term, n): how many of `members` (name) lie below each category (term)."""
    return cones(edges, categories).join(members, "name", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def refinements(edges: DataFrame, members: DataFrame, category: str) -> DataFrame:
    """(term, n): the children of a category that narrow `members` without emptying them."""
    return facets(edges, members, edges.where(F.col("parent") == category).select(F.col("child").alias("term")))


def complete(edges: DataFrame, prefix: str, most: int = 40) -> DataFrame:
    """The first names that begin with `prefix`, whatever the case."""
    return names(edges).where(F.lower("name").startswith(prefix.lower())).orderBy("name").limit(most)


def narrowing(edges: DataFrame, members: DataFrame, asked: list[str]) -> DataFrame:
    """(term, n): every category above some but not all of `members` (name), the root and the asked
    terms left out; most first, then by name. Fewer than two members cannot be narrowed."""
    up = ancestors_of(edges, members.select(F.col("name").alias("term")).distinct())
    total = members.select(F.countDistinct("name").alias("total"))
    counts = up.where(~F.col("name").isin(["*", *asked])).groupBy(F.col("name").alias("term")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.col("n") < F.col("total")).select("term", "n").orderBy(F.desc("n"), "term")  # total: one row


def contested(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(name) below both terms, unless one of them is below the other: then there is no contest."""
    pairs = edges.sparkSession.createDataFrame([(first, second), (second, first)], "sub string, sup string")
    entailed = is_below(edges, pairs).where("below").select(F.lit(1).alias("x")).limit(1)
    return get(edges, [first, second]).join(entailed, F.col("x").isNotNull(), "left_anti")


def focus(edges: DataFrame, name: str) -> DataFrame:
    """(side, name): the parents and children of one name."""
    above = edges.where(F.col("child") == name).select(F.lit("above").alias("side"), F.col("parent").alias("name"))
    return above.unionByName(edges.where(F.col("parent") == name).select(F.lit("below").alias("side"), F.col("child").alias("name")))


def broad_cones(edges: DataFrame, threshold: int = 64) -> DataFrame:
    """(term, name): the cones of all categories with at least `threshold` names below them: the
    table to publish as an index, so that queries on broad terms need no traversal."""
    found = cones(edges, edges.select(F.col("parent").alias("term")))
    broad = found.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return found.join(broad, "term", "left_semi").select("term", "name")
