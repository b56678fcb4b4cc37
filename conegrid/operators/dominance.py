"""Dominance join of tuples by a grid of cells: which tuples are at least as large in every part.

Every part's values are cut at quantiles, so a tuple lies in one cell of a grid. A tuple can only dominate tuples of cells
that are nowhere above its own; such pairs of cells, whose number depends on the grid and not on the rows, are what rows are joined
on, and the exact test comes last. In a cell that is below in every part everything is an answer; only cells that share
a slab with the tuple's propose more than that. Cells with many rows are dealt into shares on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Cuts of each part, and rows of a cell's share.
CUTS, SHARE = 7, 20_000


def dominance_join(outer: DataFrame, inner: DataFrame, group: list[str], point: str, test: Callable[[Column, Column], Column], slack: float = 1e-9, cuts: int = CUTS, share: int = SHARE) -> DataFrame:
    """(r, p), as structs: every row of `outer` with every row of `inner` of its group whose `point` (array of doubles, of one
    length in a group) is nowhere above its own and which passes test(r, p). slack: how much doubles may err, relatively;
    the grid never loses a pair for it. Null groups and points join nothing."""
    whole = lambda rows: rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*group, point]))
    inner, outer = whole(inner), whole(outer)
    parts = inner.select(*group, F.posexplode(point).alias("_d", "_x"))
    at = [i / (cuts + 1) for i in range(1, cuts + 1)]
    bounds = parts.groupBy(*group, "_d").agg(F.percentile_approx("_x", at, 1000).alias("_cut"))
    bounds = materialize(bounds.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_d", "_cut"))).alias("_cuts")))  # a row a group

    def placed(rows: DataFrame, side: str, lift: float) -> tuple[DataFrame, DataFrame]:
        """Rows with their cell and share, and the cells with their numbers of shares."""
        cell = F.zip_with(point, "_cuts", lambda x, c: F.size(F.filter(c["_cut"], lambda b: b < x + lift * F.abs(x))))
        kept = materialize(rows.join(bounds, group).select(*group, F.struct(*rows.columns).alias(side), cell.alias(f"{side}_cell")))
        cells = materialize(kept.groupBy(*group, f"{side}_cell").agg(F.ceil(F.count("*") / share).alias(f"{side}_shares")))
        dealt = kept.join(cells, [*group, f"{side}_cell"]).withColumn(f"{side}_share", F.pmod(F.xxhash64(side), F.col(f"{side}_shares")))
        return dealt.drop(f"{side}_shares"), cells

    r, r_cells = placed(outer, "r", slack)
    p, p_cells = placed(inner, "p", 0.0)
    nowhere_above = F.forall(F.arrays_zip(F.col("p_cell").alias("p"), F.col("r_cell").alias("r")), lambda x: x["p"] <= x["r"])
    pairs = r_cells.join(p_cells, group).where(nowhere_above)
    for side in "rp":
        pairs = pairs.withColumn(f"{side}_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_shares") - 1))).drop(f"{side}_shares")
    met = r.join(pairs, [*group, "r_cell", "r_share"]).join(p, [*group, "p_cell", "p_share"])
    return met.where(test(F.col("r"), F.col("p"))).select("r", "p")
