"""Typed values as columns: closed intervals, calendar periods, prefix codes and dominance tuples.

Bounds are exact decimals or timestamps; a null bound is open. Containment and overlap are plain
column predicates, so they reach the scan as filters where one side is constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(outer_lo: Column, outer_hi: Column, inner_lo: Column, inner_hi: Column) -> Column:
    """Whether the closed interval `inner` lies in `outer`."""
    low = outer_lo.isNull() | F.coalesce(inner_lo >= outer_lo, F.lit(False))
    high = outer_hi.isNull() | F.coalesce(inner_hi <= outer_hi, F.lit(False))
    return low & high


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Whether two closed intervals share a point."""
    return F.coalesce(a_lo <= b_hi, F.lit(True)) & F.coalesce(b_lo <= a_hi, F.lit(True))


def prefix_contains(outer: Column, inner: Column) -> Column:
    return inner.startswith(outer)


def dominates(outer: Column, inner: Column) -> Column:
    """Whether every component of `outer`, sorted descending, is at least that of `inner`."""
    big, small = F.sort_array(outer, asc=False), F.sort_array(inner, asc=False)
    return (F.size(outer) == F.size(inner)) & F.forall(F.arrays_zip(big.alias("o"), small.alias("i")), lambda x: x["o"] >= x["i"])


def period(text: Column) -> tuple[Column, Column]:
    """First and last second of a period YYYY, YYYY-MM or YYYY-MM-DD."""
    n = F.length(text)
    first = F.to_timestamp(F.when(n == 4, F.concat(text, F.lit("-01-01"))).when(n == 7, F.concat(text, F.lit("-01"))).otherwise(text), "yyyy-MM-dd")
    after = F.when(n == 4, F.add_months(first, 12)).when(n == 7, F.add_months(first, 1)).otherwise(F.date_add(first, 1)).cast("timestamp")
    return first, after - F.expr("INTERVAL 1 SECOND")
