"""Streaming ingest of projection lines: each micro-batch appends only edges not yet in the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.text import PROJECTION, projection_edges


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start the stream; idempotent, since edges are a set and a replayed batch adds nothing new. A line
    that does not parse stops it. The table holds assertions as they came: reduce_edges gives their
    canonical form, once, not at every batch."""
    rows = spark.readStream.schema(PROJECTION).option("mode", "FAILFAST").json(source)

    def append(batch: DataFrame, _: int) -> None:
        new = projection_edges(batch)
        have = batch.sparkSession.read.schema("parent string, child string").option("ignoreMissingFiles", "true").parquet(target)
        new.join(have, ["parent", "child"], "left_anti").write.mode("append").parquet(target)

    spark.createDataFrame([], "parent string, child string").write.mode("append").parquet(target)
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
