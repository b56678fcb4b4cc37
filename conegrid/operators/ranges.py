"""Joins of points and ranges that deal rows evenly, whatever the groups, ties and widths.

Points and the ends of ranges are sorted together once, by a range partitioning, so every point gets a
global rank and every range the first and last rank inside it. Ranks are cut into blocks of as many
points as a range holds on average, `BLOCK` at least and `MOST` at most: a point is in one block, a range in those that it spans, and the two meet by an equi-join on the block. A block that
a range spans wholly gives only answers, so work follows the output and two blocks a range; a group with all
rows, or one value repeated, is spread like any other. Blocks that very many ranges span are dealt into shares.

Ends are of any type that Spark sorts, and closed; a null end is open; a range that ends before it begins is
empty and joins nothing. Rows with a null group join nothing; an
empty side gives no rows; repeated rows join each on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize

#: Points of a block at least and at most, and ranges that meet a block in one share.
BLOCK, MOST, SHARE = 64, 4096, 50_000
#: Order of events at one place: what begins there, points, what begins right after it, what ends there.
_BEGIN, _POINT, _BEYOND, _END = range(4)


def _running(events: DataFrame) -> DataFrame:
    """`events`, sorted within partitions, with _before: the points before each row in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            point = batch.column("_kind").to_numpy() == _POINT
            upto = so_far + np.cumsum(point)
            yield batch.append_column("_before", pa.array(upto - point))
            so_far += int(point.sum())

    return events.mapInArrow(run, StructType([*events.schema.fields, StructField("_before", LongType())]))


def _ranked(points: DataFrame, ranges: DataFrame, group: list[str], strict: bool) -> tuple[DataFrame, DataFrame]:
    """(_rank, p) of every point and (_id, first, last) of every range; points (group, at, p), ranges (group, lo, hi, _id)."""
    null, key = F.lit(None), F.struct(*group)
    end = lambda at, kind, open_: ranges.select(key.alias("_g"), F.when(F.col(at).isNull(), open_).otherwise(0).alias("_side"), F.col(at).alias("_at"), F.lit(kind).alias("_kind"), "_id", null.cast(points.schema["p"].dataType).alias("p"))
    at = points.select(key.alias("_g"), F.when(F.col("at").isNull(), -1).otherwise(0).alias("_side"), F.col("at").alias("_at"), F.lit(_POINT).alias("_kind"), F.monotonically_increasing_id().alias("_id"), "p")
    events = at.unionByName(end("lo", _BEYOND if strict else _BEGIN, -1)).unionByName(end("hi", _END, 1)).where(" AND ".join(f"_g.{g} IS NOT NULL" for g in group))
    order = ["_g", "_side", "_at", "_kind", "_id"]  # the last differs between points, so no number of ties stays together
    dealt = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = materialize(_running(dealt))
    sizes = placed.where(F.col("_kind") == _POINT).groupBy("_part").agg(F.count("*").alias("n"))
    every = placed.select("_part").distinct().join(sizes, "_part", "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = every.select("_part", F.coalesce(so_far, F.lit(0)).alias("_offset"))  # a row a partition
    at = placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_offset"))
    spans = at.where(F.col("_kind") != _POINT).groupBy("_id").agg(F.min(F.when(F.col("_kind") != _END, F.col("_rank"))).alias("first"), (F.max(F.when(F.col("_kind") == _END, F.col("_rank"))) - 1).alias("last"))
    return at.where(F.col("_kind") == _POINT).select("_rank", "p"), spans.where("first <= last")


def points_in_ranges(points: DataFrame, ranges: DataFrame, group: list[str], at: str, lo: str, hi: str, strict: bool = False, test: Callable[[Column, Column], Column] | None = None, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(r, p): every row of `ranges` with every row of `points` of its group whose `at` lies in lo..hi, as
    structs; strict: after lo. A null `at` lies before everything. test(r, p), if given, decides on the pairs that the ranges propose."""
    own = materialize(ranges.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("r")))
    ends = own.select(*[F.col(f"r.{g}").alias(g) for g in group], F.col(f"r.{lo}").alias("lo"), F.col(f"r.{hi}").alias("hi"), "_id")
    ranked, spans = _ranked(points.select(*group, F.col(at).alias("at"), F.struct("*").alias("p")), ends, group, strict)
    # a range goes with its spans: joined to the pairs instead, every pair would be shuffled
    spans = materialize(spans.join(own, "_id").select("_id", "r", "first", "last"))
    # blocks as long as a range on average, within bounds: ranges then span few, and no block fills a task
    block = max(block, min(MOST, ceil(spans.agg(F.avg(F.col("last") - F.col("first") + 1)).first()[0] or 0)))
    spread = spans.select("*", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("_block"))
    spread = materialize(spread)
    loads = spread.groupBy("_block").agg(F.ceil(F.count("*") / share).alias("_shares")).where("_shares > 1")  # a row for `share` rows at most
    shares = F.coalesce("_shares", F.lit(1))
    left = spread.join(loads, "_block", "left").withColumn("_share", F.pmod(F.xxhash64("_id"), shares))
    right = ranked.withColumn("_block", F.floor(F.col("_rank") / block)).join(loads, "_block", "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    met = left.drop("_shares").join(right.drop("_shares"), ["_block", "_share"]).where("_rank BETWEEN first AND last").select("r", "p")
    return met if test is None else met.where(test(F.col("r"), F.col("p")))


def _sound(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """The rows whose range is not empty."""
    return rows.where(F.coalesce(F.col(lo) <= F.col(hi), F.lit(True)))


def containment_join(outer: DataFrame, inner: DataFrame, group: list[str], lo: str = "lo", hi: str = "hi", **sizes: int) -> DataFrame:
    """(r, p): every range of `outer` with every range of `inner` inside it, as structs."""
    inside = lambda r, p: r[hi].isNull() | F.coalesce(p[hi] <= r[hi], F.lit(False))
    return points_in_ranges(_sound(inner, lo, hi), outer, group, lo, lo, hi, test=inside, **sizes)


def overlap_join(a: DataFrame, b: DataFrame, group: list[str], lo: str = "lo", hi: str = "hi", **sizes: int) -> DataFrame:
    """(a, b): every pair of ranges with a common part, once, as structs: one of the two begins inside the other."""
    a, b = _sound(a, lo, hi), _sound(b, lo, hi)
    first = points_in_ranges(b, a, group, lo, lo, hi, **sizes).select(F.col("r").alias("a"), F.col("p").alias("b"))
    second = points_in_ranges(a, b, group, lo, lo, hi, strict=True, **sizes).select(F.col("p").alias("a"), F.col("r").alias("b"))
    return first.unionAll(second)
