"""Formal concept analysis over an incidence table (obj, attr): closures as relational division.

Derivations of given attributes are one grouped count. Enumerating all concepts is exponential in the
attributes by nature, so it is for small contexts: it spreads candidate sets over tasks level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def extent(incidence: DataFrame, attrs: list[str]) -> DataFrame:
    """(obj): the objects with all the attributes; none asked: all objects."""
    own = incidence.select("obj", "attr").distinct()
    wanted = sorted(set(attrs))
    if not wanted:
        return own.select("obj").distinct()
    return own.where(F.col("attr").isin(wanted)).groupBy("obj").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("obj")


def intent(incidence: DataFrame, objects: DataFrame) -> DataFrame:
    """(attr): the attributes that all the objects (obj) share; of no objects: all attributes."""
    own = incidence.select("obj", "attr").distinct()
    chosen = materialize(objects.select("obj").distinct())
    total = chosen.count()
    if not total:
        return own.select("attr").distinct()
    return own.join(chosen, "obj", "left_semi").groupBy("attr").agg(F.count("*").alias("n")).where(F.col("n") == total).select("attr")


def closure(incidence: DataFrame, attrs: list[str]) -> DataFrame:
    """(attr): the attributes that go with the given ones wherever these occur together."""
    return intent(incidence, extent(incidence, attrs))


def density(incidence: DataFrame) -> DataFrame:
    """(objects, attributes, pairs, density) of a context."""
    own = incidence.select("obj", "attr").distinct()
    n = own.agg(F.countDistinct("obj").alias("objects"), F.countDistinct("attr").alias("attributes"), F.count("*").alias("pairs"))
    return n.withColumn("density", F.round(F.col("pairs") / (F.col("objects") * F.col("attributes")), 6))


def concepts(incidence: DataFrame, most: int = 100_000) -> DataFrame:
    """(intent, support): all concepts, as sorted attributes and the number of objects that have them.

    Every intent but the greatest is a meet of objects' intents: from the distinct rows of the table,
    meets with one more row are taken until no new one comes. More than `most` are refused."""
    own = incidence.select("obj", "attr").distinct()
    rows = materialize(own.groupBy("obj").agg(F.array_sort(F.collect_list("attr")).alias("row")).groupBy("row").agg(F.count("*").alias("n")))
    every = own.agg(F.array_sort(F.collect_set("attr")).alias("intent"))
    found = materialize(rows.select(F.col("row").alias("intent")).union(every).distinct())
    fresh = found
    while True:
        met = fresh.join(rows.select("row")).select(F.array_sort(F.array_intersect("intent", "row")).alias("intent")).distinct()  # distinct rows of a small context
        fresh = materialize(met.join(found, "intent", "left_anti"))
        if fresh.isEmpty():
            break
        found = materialize(found.union(fresh))
        if found.count() > most:
            raise ValueError(f"more than {most} concepts")
    has = rows.join(found, F.size(F.array_except("intent", "row")) == 0).groupBy("intent").agg(F.sum("n").alias("support"))
    return found.join(has, "intent", "left").select("intent", F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def covers(found: DataFrame) -> DataFrame:
    """(upper, lower): the cover edges of the lattice of concepts (intent, ...): no intent lies between."""
    a, b = (found.select(F.col("intent").alias(x)) for x in ("upper", "lower"))
    pairs = materialize(b.join(a, (F.size("upper") < F.size("lower")) & (F.size(F.array_except("upper", "lower")) == 0)))
    via = pairs.select("upper", F.col("lower").alias("mid")).join(pairs.select(F.col("upper").alias("mid"), "lower"), "mid").select("upper", "lower").distinct()
    return pairs.select("upper", "lower").join(via, ["upper", "lower"], "left_anti")


def stability(incidence: DataFrame, attrs: list[str], most: int = 16) -> float:
    """The share of subsets of an extent that have its very intent; for extents of at most `most` objects."""
    own = incidence.select("obj", "attr").distinct()
    objects = extent(own, attrs).withColumn("i", F.row_number().over(Window.orderBy("obj"))).limit(most + 1)  # at most that many
    objects = materialize(objects)
    n = objects.count()
    if n > most:
        raise ValueError("an extent of so many objects has too many subsets")
    others = own.select("attr").distinct().join(intent(own, objects), "attr", "left_anti")
    lacks = objects.join(others).join(own, ["obj", "attr"], "left_anti")  # a bounded number of objects
    masks = lacks.groupBy("attr").agg(F.bit_or(F.expr("shiftleft(1L, i - 1)")).alias("without"))
    subsets = own.sparkSession.range(1 << n).withColumnRenamed("id", "set")
    # a subset has the same intent if each other attribute is lacked by one of its objects
    differ = subsets.join(F.broadcast(masks), F.col("set").bitwiseAND(F.col("without")) == 0).select("set").distinct()  # a row an attribute
    return 1 - differ.count() / (1 << n)


def unnamed(found: DataFrame, codes: DataFrame) -> DataFrame:
    """(intent): concepts that are the code of no name (code: sorted attributes), but for the greatest
    and the least."""
    ends = found.agg(F.min(F.size("intent")).alias("a"), F.max(F.size("intent")).alias("b"))
    inner = found.join(F.broadcast(ends), (F.size("intent") > F.col("a")) & (F.size("intent") < F.col("b"))).select("intent")  # ends: one row
    return inner.join(codes.select(F.col("code").alias("intent")), "intent", "left_anti")
