"""Joins of whole texts with a table of ids that shuffle only the texts that may match.

The ids are hashed into a bit table of at most 2**bits bits, so of bounded size, which is broadcast; what
fails it is decided without a shuffle, and the rest goes through the exact join. A fuller table lets
more texts through, never fewer. A null id is in no table; empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(rows: DataFrame, ids: DataFrame, key: str, bits: int) -> DataFrame:
    """`rows` with _maybe: whether the key may be among the ids."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_set"))
    met = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(words), "_word", "left")
    return met.withColumn("_maybe", F.expr("coalesce(getbit(_set, _bit), 0) = 1")).drop("_word", "_bit", "_set")


def with_ids(rows: DataFrame, ids: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """The rows whose key is among the distinct `ids`.

    An inner join, since a semi join would be pushed below the bit table; merged at every size, so that
    the plan does not change with it."""
    return _marked(rows, ids, key, bits).where("_maybe").drop("_maybe").join(ids.select(key).hint("merge"), key).select(rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """The rows whose key is not among the distinct `ids`; a null key is not."""
    marked = _marked(rows, ids, key, bits)
    asked = marked.where("_maybe").join(ids.select(key, F.lit(True).alias("_gone")).hint("merge"), key, "left").where("_gone IS NULL")
    return marked.where("NOT _maybe").select(rows.columns).unionByName(asked.select(rows.columns))
