"""A stream of peers' versions folded into a store of our own: it only grows, whatever comes twice or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.group_store import GroupStore

ANNOUNCED = "peer string, root string"


def fold_stream(spark: SparkSession, source: str, store: str, checkpoint: str, digits: int = 3) -> StreamingQuery:
    """Start the stream over a folder of JSON lines {"peer": <its store>, "root": <a version>}.

    Each micro-batch folds its versions in, reading only the groups that differ. A fold takes the union of claims, so
    a replayed batch changes nothing, and any order ends in one root. Lines without a peer or root are left out; a
    version that a peer's store has not stops the stream. Claims are kept as they came: reduce_edges
    gives their canonical form."""
    rows = spark.readStream.schema(ANNOUNCED).option("maxFilesPerTrigger", 100).json(source)

    def take(batch: DataFrame, _: int) -> None:
        own = GroupStore(batch.sparkSession, store, digits)
        for r in batch.where("peer IS NOT NULL AND root IS NOT NULL").distinct().orderBy("peer", "root").collect():  # a row an announcement
            own.fold(GroupStore(batch.sparkSession, r["peer"], digits), r["root"])

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
