import random

import pytest
from pyspark.sql import functions as F

from conegrid.operators.dominance import dominance_join

ROW = "g string, name string, at array<double>"


@pytest.mark.parametrize("cuts, share", [(7, 20_000), (2, 3)])
def test_dominance_matches_brute_force(spark, cuts, share):
    rng = random.Random(cuts)
    make = lambda p, n: [(rng.choice("aab"), f"{p}{i}", [float(rng.randint(0, 9)) for _ in range(3)]) for i in range(n)]
    a, b = make("r", 60), [*make("p", 80), ("a", "tie", [5.0, 5.0, 5.0]), ("a", "tie", [5.0, 5.0, 5.0]), (None, "no group", [0.0, 0.0, 0.0]), ("a", "no point", None)]
    fits = lambda r, p: F.forall(F.arrays_zip(r["at"].alias("r"), p["at"].alias("p")), lambda x: x["p"] <= x["r"])
    got = dominance_join(*(spark.createDataFrame(x, ROW) for x in (a, b)), ["g"], "at", fits, cuts=cuts, share=share)
    want = sorted((r[1], p[1]) for r in a for p in b if r[0] == p[0] and p[2] and all(x <= y for x, y in zip(p[2], r[2])))
    assert sorted(map(tuple, got.select("r.name", F.col("p.name").alias("other")).collect())) == want
    assert dominance_join(spark.createDataFrame([], ROW), spark.createDataFrame(b, ROW), ["g"], "at", fits).count() == 0
    assert dominance_join(spark.createDataFrame(a, ROW), spark.createDataFrame([], ROW), ["g"], "at", fits).count() == 0
