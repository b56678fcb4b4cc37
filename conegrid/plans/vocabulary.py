"""Ready-made parts of a graph: an example, the typed heads, packs of units and currencies; overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions.terms import KINDS
from ..operators.canonical import merge
from ..operators.mutation import remove_cone

# The heads that users of such graphs expect, by kind, and names of currencies and coins.
HEADS = {"linear": "weight length duration area volume speed pressure temperature energy", "count": "count", "calendar": "time", "prefix": "geo", "dominance": "size"}
PACKS = {
    "coins": ["unit-family(BTC)", "unit(sat=1BTC/100000000)", "unit(mBTC=1BTC/1000)", "unit-family(ETH)", "unit(gwei=1ETH/1000000000)", "unit(wei=1gwei/1000000000)"],
    "currencies": [f"unit-family({c})" for c in "AUD BRL CAD CHF CNY CZK DKK EUR GBP HUF IDR ILS INR JPY KRW MXN NOK NZD PLN RON SEK SGD THB TRY USD ZAR".split()],
}
_PAIR = "parent string, child string"


def example(spark: SparkSession) -> DataFrame:
    """A small graph of journeys to try things on."""
    rows = [("*", "Trip"), ("*", "Norway"), ("*", "Paid"), ("Trip", "Ferry"), ("Trip", "Cabin"), ("Ferry", "Bergen crossing"), ("Norway", "Bergen crossing"), ("Cabin", "Fjord cabin"), ("Norway", "Fjord cabin"), ("Paid", "Fjord cabin"), ("Ferry", "Night ferry"), ("Paid", "Night ferry")]
    return spark.createDataFrame(rows, _PAIR)


def prelude(spark: SparkSession) -> DataFrame:
    """The kinds below `dimension`, and the usual heads below their kinds."""
    rows = [("*", "dimension"), *(("dimension", f"{k}-dimension") for k in KINDS), *((f"{k}-dimension", h) for k, hs in HEADS.items() for h in hs.split())]
    return spark.createDataFrame(rows, _PAIR)


def pack(spark: SparkSession, name: str) -> DataFrame:
    """The unit declarations of a pack; ValueError for a name that is none."""
    if name not in PACKS:
        raise ValueError(f"no pack {name!r}; there are {', '.join(sorted(PACKS))}")
    return spark.createDataFrame([("*", "unit-declaration"), *(("unit-declaration", d) for d in PACKS[name])], _PAIR)


def packs_with(unit: str) -> list[str]:
    """The packs that declare a unit or family of this spelling."""
    return sorted(p for p, ds in PACKS.items() if any(d.partition("(")[2].rstrip(")").split("=")[0] == unit for d in ds))


def adopt(edges: DataFrame, part: DataFrame) -> DataFrame:
    """`edges` with a part merged in; adopting it again changes nothing."""
    return merge(edges, part)


def overlay(*layers: DataFrame) -> DataFrame:
    """One view of several graphs, merged and reduced; the layers stay as they are."""
    return reduce(merge, layers)


def rebuild(edges: DataFrame, node: str, projection: DataFrame) -> DataFrame:
    """`edges` with what only hangs below `node` dropped, and a projection's claims in its place; what
    is also below others stays there."""
    return merge(remove_cone(edges, node), projection)
