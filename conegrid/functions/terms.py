"""Typed terms `head(value)`: reading, canonical spelling, and their columns for Spark.

A value of a linear, calendar or count head is a closed interval (a null end is open), of a dominance
head a tuple of amounts in descending order, of a prefix head a code. Amounts are exact fractions of the
family's anchor unit; instants are whole seconds. Equal values have one spelling, so the spelling is the
name. read() and write() work on one term; parsed() applies them to a column and gives each end as
numerator and denominator, which compare by multiplication inside Spark, without floats.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import AFFINE, ANCHORS, UNITS, Units

KINDS = ("linear", "calendar", "count", "dominance", "prefix")
TERM = r"^([^()]+)\(([^()]+)\)$"
TIME = "time"
_AMOUNT = re.compile(r"(-?\d+(?:\.\d+)?(?:/\d+)?)([A-Za-z][A-Za-z0-9]*)?")
_CODE = re.compile(r"[0-9A-Za-z][0-9A-Za-z._-]*")
_PERIODS = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d", 20: "%Y-%m-%dT%H:%M:%SZ"}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Value(NamedTuple):
    kind: str
    family: str
    lo: Fraction | None = None
    hi: Fraction | None = None
    parts: tuple[Fraction, ...] = ()
    code: str | None = None

    @property
    def space(self) -> str:
        """What all values of one head must share."""
        return {"prefix": "prefix", "dominance": f"dominance:{self.family}:{len(self.parts)}"}.get(self.kind, f"linear:{self.family}")


def split_term(name: str) -> tuple[str, str] | None:
    m = re.match(TERM, name)
    return (m[1], m[2]) if m else None


def amount(text: str, units: Units) -> tuple[str, Fraction]:
    """(family, amount in anchor units) of a number with a unit or without."""
    m = _AMOUNT.fullmatch(text)
    if not m:
        raise ValueError(f"not an amount: {text!r}")
    number, unit = m[1], m[2] or ""
    if number.partition("/")[2].strip("0") == "" and "/" in number:
        raise ValueError(f"zero denominator: {text!r}")
    top, _, bottom = number.partition("/")
    value = Fraction(top) / Fraction(bottom or 1)
    if unit in AFFINE:
        family, factor, offset = AFFINE[unit]
        value = value * factor + offset
        if value < 0:
            raise ValueError(f"below absolute zero: {text!r}")
        return family, value
    if unit not in units:
        raise ValueError(f"unknown unit {unit!r} in {text!r}")
    if value < 0:
        raise ValueError(f"negative: {text!r}")
    return units[unit][0], value * units[unit][1]


def period(text: str, shortest: int) -> tuple[Fraction, Fraction] | None:
    """First and last second of a year, month, day or instant; None for other texts or shorter ones."""
    if len(text) < shortest or len(text) not in _PERIODS or not re.fullmatch(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d:\d\dZ)?)?)?", text):
        return None
    try:
        first = datetime.strptime(text, _PERIODS[len(text)]).replace(tzinfo=timezone.utc)
    except ValueError:
        raise ValueError(f"no such date: {text!r}") from None
    lasts = {4: lambda: first.replace(month=12, day=31), 7: lambda: (first.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)}
    start = Fraction(int((first - _EPOCH).total_seconds()))
    if len(text) == 20:
        return start, start
    return start, Fraction(int((lasts.get(len(text), lambda: first)() - _EPOCH).total_seconds())) + 86399


def interval(param: str, one: Callable[[str], tuple[str, Fraction, Fraction]], floor: Callable[[str], Fraction | None]) -> tuple[str, Fraction | None, Fraction | None]:
    """(family, lo, hi) of `value`, `lo..hi`, `lo..` or `..hi`; one(text) reads an end as (family, first, last)."""
    if ".." not in param:
        return one(param)
    ends = param.split("..")
    if len(ends) != 2 or ends == ["", ""]:
        raise ValueError(f"not a range: {param!r}")
    low, high = (one(e) if e else None for e in ends)
    if low and high and low[0] != high[0]:
        raise ValueError(f"ends of two families: {param!r}")
    family = (low or high)[0]
    lo, hi = low[1] if low else floor(family), high[2] if high else None
    if lo is not None and hi is not None and lo > hi:
        raise ValueError(f"empty range: {param!r}")
    return family, lo, hi


def read(param: str, kind: str, units: Units = UNITS) -> Value:
    """The value of a parameter under a head of this kind; ValueError if it has none."""
    if kind == "prefix":
        if ".." in param or not _CODE.fullmatch(param):
            raise ValueError(f"not a code: {param!r}")
        return Value(kind, "prefix", code=param)
    if kind == "dominance":
        parts, unit = [], ""
        for p in reversed(param.split("x")):
            m = _AMOUNT.fullmatch(p)
            if not m:
                raise ValueError(f"not an amount: {p!r} in {param!r}")
            unit = m[2] or unit  # a unit holds for the parts to its left as well
            parts.append(amount(m[1] + unit, units))
        if len(parts) < 2 or len({f for f, _ in parts}) != 1:
            raise ValueError(f"not a tuple of one family: {param!r}")
        return Value(kind, parts[0][0], parts=tuple(sorted((v for _, v in parts), reverse=True)))

    def one(text: str) -> tuple[str, Fraction, Fraction]:
        found = period(text, 4 if kind == "calendar" else 10) if kind != "count" else None
        if found:
            return TIME, *found
        if kind == "calendar":
            raise ValueError(f"not a calendar value: {text!r}")
        family, value = amount(text, units)
        if kind == "count" and (family != "count" or value < 1 or value.denominator != 1):
            raise ValueError(f"not a whole count from 1: {text!r}")
        return family, value, value

    return Value(kind, *interval(param, one, lambda family: None if family == TIME else Fraction(int(kind == "count"))))


def write(value: Value) -> str:
    """The one spelling of a value."""
    if value.kind == "prefix":
        return value.code
    suffix = ANCHORS.get(value.family, value.family)
    if value.kind == "dominance":
        return "x".join(map(str, value.parts)) + suffix
    spell = lambda x: (_EPOCH + timedelta(seconds=int(x))).strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20) if value.family == TIME else f"{x}{suffix}"
    if value.lo is not None and value.lo == value.hi:
        return spell(value.lo)
    least = None if value.family == TIME else int(value.kind == "count")
    lo = "" if value.lo is None or value.lo == least and value.hi is not None else spell(value.lo)
    return f"{lo}..{'' if value.hi is None else spell(value.hi)}"


def canonical(name: str, kind: str, units: Units = UNITS) -> str:
    split = split_term(name)
    if not split:
        raise ValueError(f"not a typed term: {name!r}")
    return f"{split[0]}({write(read(split[1], kind, units))})"


def meet(a: Value, b: Value) -> Value | None:
    """The common part of two values of one space; None if they have none."""
    if a.space != b.space:
        raise ValueError(f"values of {a.space} and {b.space}")
    if a.kind == "prefix":
        long, short = sorted((a, b), key=lambda v: len(v.code), reverse=True)
        return long if long.code.startswith(short.code) else None
    if a.kind == "dominance":
        return a._replace(parts=tuple(map(min, zip(a.parts, b.parts, strict=True))))
    lo = max((x for x in (a.lo, b.lo) if x is not None), default=None)
    hi = min((x for x in (a.hi, b.hi) if x is not None), default=None)
    return None if lo is not None and hi is not None and lo > hi else a._replace(lo=lo, hi=hi)


def render(name: str, kind: str, units: Units = UNITS) -> str:
    """A canonical term with the largest unit of its family that makes every number whole; whole
    calendar periods in their short form. Never fails: what it cannot read stays as it is."""
    split = split_term(name)
    try:
        value = read(split[1], kind, units)
    except (TypeError, ValueError):
        return name
    if value.family == TIME:
        for size in (4, 7, 10):
            texts = [(_EPOCH + timedelta(seconds=int(x))).strftime(_PERIODS[size]) for x in (value.lo, value.hi) if x is not None]
            if value.lo is not None and value.hi is not None and period(texts[0], 4) == (value.lo, value.hi) and (kind == "calendar" or size == 10):
                return f"{split[0]}({texts[0]})"
        return f"{split[0]}({write(value)})"
    numbers = [x for x in (*value.parts, value.lo, value.hi) if x]
    whole = [(f, u) for u, (family, f) in units.items() if family == value.family and numbers and all((x / f).denominator == 1 for x in numbers)]
    if kind in ("prefix", "count") or not whole or value.family == "count":
        return f"{split[0]}({write(value)})"
    factor, unit = max(whole, key=lambda x: (x[0], x[1]))
    text = write(value._replace(family=unit, parts=tuple(x / factor for x in value.parts), lo=value.lo and value.lo / factor, hi=value.hi and value.hi / factor))
    return f"{split[0]}({text})"


RATIO = "struct<n:decimal(38,0),d:decimal(38,0)>"
PARSED = f"canonical string, space string, lo {RATIO}, hi {RATIO}, parts array<{RATIO}>, code string, error string"


def parsed(name: Column, kind: Column, units: Units = UNITS) -> Column:
    """A struct of PARSED for each term; a term without a value has an error and nulls."""
    limit = 10**18  # products of two such numbers fit into 38 digits, so at_most is exact
    ratio = lambda x: None if x is None else (x.numerator, x.denominator)

    def row(n: str | None, k: str | None) -> tuple:
        try:
            head, param = split_term(n or "") or (None, "")
            if head is None or k not in KINDS:
                raise ValueError("not a typed term of a known kind")
            v = read(param, k, units)
            if any(max(x.numerator, x.denominator) > limit for x in (*v.parts, *(y for y in (v.lo, v.hi) if y is not None))):
                raise ValueError("too large or too fine for exact comparison")
            return f"{head}({write(v)})", v.space, ratio(v.lo), ratio(v.hi), [ratio(x) for x in v.parts] or None, v.code, None
        except ValueError as e:
            return None, None, None, None, None, None, str(e)

    @F.udf(PARSED, useArrow=True)
    def parse(n: str | None, k: str | None) -> tuple:
        c, s, lo, hi, parts, code, error = row(n, k)
        pair = lambda x: None if x is None else tuple(map(Decimal, x))
        return c, s, pair(lo), pair(hi), parts and [pair(x) for x in parts], code, error

    return parse(name, kind)


def at_most(a: Column, b: Column) -> Column:
    """Whether ratio a <= ratio b, exactly: parsed() refuses numbers whose products would not fit."""
    return a["n"] * b["d"] <= b["n"] * a["d"]


def contains(outer: Column, inner: Column) -> Column:
    """Whether a parsed value of one head holds another (the same kind and space)."""
    low = outer["lo"].isNull() | F.coalesce(at_most(outer["lo"], inner["lo"]), F.lit(False))
    high = outer["hi"].isNull() | F.coalesce(at_most(inner["hi"], outer["hi"]), F.lit(False))
    fits = F.forall(F.arrays_zip(outer["parts"].alias("o"), inner["parts"].alias("i")), lambda x: at_most(x["i"], x["o"]))
    by = F.when(inner["code"].isNotNull(), inner["code"].startswith(outer["code"])).when(inner["parts"].isNotNull(), fits).otherwise(low & high)
    return F.coalesce((outer["space"] == inner["space"]) & by, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two parsed values of one head have a common part; tuples always have."""
    ends = F.coalesce(at_most(a["lo"], b["hi"]), F.lit(True)) & F.coalesce(at_most(b["lo"], a["hi"]), F.lit(True))
    codes = a["code"].startswith(b["code"]) | b["code"].startswith(a["code"])
    return F.coalesce((a["space"] == b["space"]) & F.when(a["code"].isNotNull(), codes).when(a["parts"].isNotNull(), F.lit(True)).otherwise(ends), F.lit(False))
