"""What taking another graph over would do, told before it is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import UNITS, Units, resolve
from ..session import materialize
from .canonical import news, unrelated
from .combined import whole
from .queries import names
from .valued import UNIT_DECLARATION, values


def unit_conflicts(edges: DataFrame, units: Units = UNITS) -> DataFrame:
    """(name, other): the spellings of declared units that cannot be had, and why: defined twice, also against a
    built-in unit, or never resolved. Declarations are few and are resolved on the driver."""
    said = edges.where(F.col("parent") == UNIT_DECLARATION).select("child").distinct().orderBy("child").collect()
    _, wrong = resolve([r["child"] for r in said], units)
    return edges.sparkSession.createDataFrame(sorted(wrong.items()), "name string, other string")


def preview(ours: DataFrame, theirs: DataFrame, units: Units = UNITS) -> DataFrame:
    """(part, name, other): what merging `theirs` into `ours` brings.

    `item`: a new name and each of its parents there; `claim`: a known name and a new parent, whose claim ours does
    not hold; `conflict`: a unit that the union cannot define, and why, so that the merge must not be
    made; `unrelated`: a category of both sides whose ancestors have nothing in common, and each of its arriving
    parents, which may mean that two things share a name. Items that both sides file differently are none."""
    own, other = ours.select("parent", "child").distinct(), theirs.select("parent", "child").distinct()
    known = materialize(names(own))
    fresh = other.join(known.withColumnRenamed("name", "child"), "child", "left_anti")
    claims = news(own, other).join(known.withColumnRenamed("name", "child"), "child", "left_semi")
    told = unit_conflicts(own.unionByName(other).distinct(), units)
    # a spelling in conflict is named, not read: the order is that of values by the units that both sides share
    sides = [whole(e, materialize(values(e, units))) for e in (own, other)]
    broad = own.unionByName(other).select(F.col("parent").alias("name")).distinct()
    apart = unrelated(*sides).join(broad, "name", "left_semi")
    doubtful = other.join(apart.select(F.col("name").alias("child")), "child", "left_semi")
    part = lambda rows, what: rows.select(F.lit(what).alias("part"), F.col("child").alias("name"), F.col("parent").alias("other"))
    found = part(fresh, "item").union(part(claims, "claim")).union(part(doubtful, "unrelated"))
    return found.union(told.select(F.lit("conflict").alias("part"), "name", "other"))
