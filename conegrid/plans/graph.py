"""The category graph of the standard tables, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, table

ROOT = "*"
# keys make all rows distinct but the segments', so only those are compared
EDGES_SQL = """
SELECT '*' AS parent, 'region:' || r_name AS child FROM region
UNION ALL SELECT 'region:' || r_name, 'nation:' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'nation:' || n_name, 'cust:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT '*', 'segment:' || c_mktsegment FROM customer
UNION ALL SELECT 'segment:' || c_mktsegment, 'cust:' || c_custkey FROM customer
UNION ALL SELECT 'cust:' || o_custkey, 'order:' || o_orderkey FROM orders
"""
LINES_SQL = """
UNION ALL SELECT 'order:' || l_orderkey, 'line:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem
"""


_written: dict[tuple[str, str, bool], DataFrame] = {}


def edges(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    """(parent, child), each once, written to the shared folder once an application and data directory,
    since traversals read it every round."""
    key = (spark.sparkContext.applicationId, sf_dir, lines)
    if key not in _written:
        _written[key] = _edges(spark, sf_dir, lines)
    return _written[key]


def _edges(spark: SparkSession, sf_dir: str, lines: bool) -> DataFrame:
    names = ["region", "nation", "customer", "orders", *["lineitem"] * lines]
    text = EDGES_SQL + (LINES_SQL if lines else "")
    for n in names:  # the tables are handed over as arguments, not as views of the session
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return materialize(spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}))
