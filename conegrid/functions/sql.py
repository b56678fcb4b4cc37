"""Functions of the session for use in SQL: spelling and containment of typed terms, and cones of a published index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .units import UNITS, Units


def _value(name: str | None, kind: str | None, units: Units) -> T.Value | None:
    split = T.split_term(name or "")
    try:
        return T.read(split[1], kind, units) if split and kind in T.KINDS else None
    except ValueError:
        return None


def register(spark: SparkSession, cones: DataFrame, units: Units = UNITS) -> None:
    """Register `canon(term, kind)` and `holds(outer, inner, kind)`, both null for what is no value of the kind; the table
    function `cone(term)`; and `below(sub, sup)`.

    cones: (term, name), rows of a cone index that has all the categories to be asked for. The last two are
    SQL over it, so a LATERAL call becomes one join; they last as long as the session."""

    @F.udf("string", useArrow=True)
    def canon(name: str | None, kind: str | None) -> str | None:
        value = _value(name, kind, units)
        return value and f"{T.split_term(name)[0]}({T.write(value)})"

    @F.udf("boolean", useArrow=True)
    def holds(outer: str | None, inner: str | None, kind: str | None) -> bool | None:
        a, b = _value(outer, kind, units), _value(inner, kind, units)
        if a is None or b is None:
            return None
        return T.split_term(outer)[0] == T.split_term(inner)[0] and a.space == b.space and T.meet(a, b) == b

    spark.udf.register("canon", canon)
    spark.udf.register("holds", holds)
    cones.select("term", "name").createOrReplaceTempView("cone_rows")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cone(t STRING) RETURNS TABLE (name STRING) RETURN SELECT c.name FROM cone_rows AS c WHERE c.term = cone.t")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION below(sub STRING, sup STRING) RETURNS BOOLEAN RETURN sub = sup OR EXISTS (SELECT 1 FROM cone_rows AS c WHERE c.term = below.sup AND c.name = below.sub)")
