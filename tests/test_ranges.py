from datetime import date

import pytest
from pyspark.sql import functions as F

from conegrid.operators import ranges as R

INT = "g string, lo int, hi int, name string"


def brute(a, b, test):
    return sorted((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and below(x[1], x[2]) and below(y[1], y[2]) and test(x, y))


def below(x, y):
    return x is None or y is None or x <= y


def rows(prefix, seed):
    import random

    rng = random.Random(seed)
    out = []
    for i in range(120):
        lo = rng.randint(0, 60)
        out.append((rng.choice("aab"), lo, lo + rng.choice([0, 0, 1, 5, 40]), f"{prefix}{i}"))
    out += [("a", None, 10, f"{prefix}low"), ("a", 50, None, f"{prefix}high"), ("a", None, None, f"{prefix}all"), (None, 1, 2, f"{prefix}none"), ("a", 7, 7, f"{prefix}tie"), ("a", 7, 7, f"{prefix}tie"), ("a", 30, 20, f"{prefix}empty")]
    return out


@pytest.mark.parametrize("block, share", [(64, 50_000), (3, 4)])
def test_overlap_and_containment(spark, block, share):
    a, b = rows("a", 1), rows("b", 2)
    left, right = spark.createDataFrame(a, INT), spark.createDataFrame(b, INT)
    got = R.overlap_join(left, right, ["g"], block=block, share=share).select("a.name", F.col("b.name").alias("other")).collect()
    assert sorted(map(tuple, got)) == brute(a, b, lambda x, y: below(x[1], y[2]) and below(y[1], x[2]))
    got = R.containment_join(left, right, ["g"], block=block, share=share).select("r.name", F.col("p.name").alias("other")).collect()
    inside = lambda x, y: (x[1] is None or y[1] is not None and x[1] <= y[1]) and (x[2] is None or y[2] is not None and y[2] <= x[2])
    assert sorted(map(tuple, got)) == brute(a, b, inside)


def test_one_group_and_one_value_stay_spread(spark):
    """A table of one group and one repeated value: no block has more than its points, no share more than its ranges."""
    points = spark.range(500).select(F.lit("g").alias("g"), F.lit(5).alias("at"), "id")
    ranges = spark.range(7).select(F.lit("g").alias("g"), F.lit(0).alias("lo"), (F.col("id") + 3).cast("int").alias("hi"), F.col("id").alias("n"))
    met = R.points_in_ranges(points, ranges, ["g"], "at", "lo", "hi", block=16, share=2)
    assert met.count() == 5 * 500
    own = ranges.select("g", "lo", "hi", F.col("n").alias("_id"))
    ranked, spans = R._ranked(points.select("g", "at", F.struct("*").alias("p")), own, ["g"], False)
    assert ranked.groupBy(F.floor(F.col("_rank") / 16)).count().agg(F.max("count")).first()[0] == 16
    assert {(r["first"], r["last"]) for r in spans.collect()} == {(0, 499)}


def test_dates_and_empty_sides(spark):
    a = spark.createDataFrame([("x", date(2020, 1, 1), date(2020, 2, 1), "a")], "g string, lo date, hi date, name string")
    assert R.overlap_join(a, a.where("false"), ["g"]).count() == 0
    assert R.overlap_join(a.where("false"), a, ["g"]).count() == 0
    assert R.containment_join(a, a, ["g"]).count() == 1
    assert R.containment_join(a, a.withColumn("g", F.lit(None).cast("string")), ["g"]).count() == 0
