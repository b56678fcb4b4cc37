"""Published tables that answer without reading everything: edges by bucket, cones with a manifest, planned queries.

Rows are laid out in folders by a hash of the name that they are looked up by; a lookup reads only the folders of the
names asked for. A cone index also has a manifest with the root of the graph and the threshold that it was made for;
a reader that finds another root, format or no manifest walks the graph instead: slower, never wrong.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .queries import broad_cones, names
from .traversal import ancestors_of, cones, told_leaves
from .versions import record_hashes, root_of

FORMAT = "cone-buckets-1"
MANIFEST = "format string, root string, threshold long, buckets int"


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


class EdgeIndex:
    """Edges written twice, by parent and by child, so that a walk's round reads only its frontier's buckets; those to
    leaves with one parent lie in folders of their own.

    `touched` holds the buckets that walks have read, by direction."""

    def __init__(self, edges: DataFrame, buckets: int = 64) -> None:
        self.buckets, self.touched = buckets, {"down": set(), "up": set()}
        pairs = materialize(told_leaves(edges))
        turned = pairs.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "alone")
        self.tables = {
            side: materialize(rows.withColumn("bucket", _bucket("parent", buckets)).repartition("bucket"), "bucket", "alone")
            for side, rows in (("down", pairs), ("up", turned))
        }

    def _near(self, side: str, frontier: DataFrame, alone: bool | None = None) -> DataFrame:
        asked = [r[0] for r in frontier.select(_bucket("name", self.buckets)).distinct().collect()]  # a number a bucket
        self.touched[side].update(asked)
        rows = self.tables[side].where(F.col("bucket").isin(asked))
        return (rows if alone is None else rows.where(F.col("alone") == F.lit(alone))).select("parent", "child")

    def down(self, frontier: DataFrame, alone: bool | None = None) -> DataFrame:
        """(parent, child): the edges from the names of `frontier` (name) downwards, and others of their buckets. alone:
        only those to leaves with one parent, or only the others."""
        return self._near("down", frontier, alone)

    def up(self, frontier: DataFrame, alone: bool | None = None) -> DataFrame:
        """The same upwards: (parent, child) turned round."""
        return self._near("up", frontier, alone)

    def rows_read(self, side: str) -> int:
        """Rows in the buckets that walks have read on a side."""
        return self.tables[side].where(F.col("bucket").isin(sorted(self.touched[side]))).count()


def publish_cones(edges: DataFrame, path: str, threshold: int = 64, buckets: int = 64) -> str:
    """Write the cones of all categories with at least `threshold` names below them, then the manifest, to a
    new folder; the graph's root, which the manifest pins. The same graph gives the same rows whatever its history."""
    spark, root = edges.sparkSession, root_of(record_hashes(edges))
    rows = broad_cones(edges, threshold).where("term <> '*'").withColumn("bucket", _bucket("term", buckets))
    # names of one category, a third of all rows perhaps, are spread over files of its bucket
    rows.repartition("bucket", F.pmod(F.xxhash64("name"), F.lit(8))).sortWithinPartitions("term", "name").write.mode("error").partitionBy("bucket").parquet(f"{path}/cones")
    spark.createDataFrame([(FORMAT, root, threshold, buckets)], MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest")
    return root


class ConeIndex:
    """A published cone index as seen from a graph with this root; `live` is false if it was made for another."""

    def __init__(self, spark: SparkSession, path: str, root: str) -> None:
        self.spark, self.path = spark, path
        try:
            found = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").first()
        except AnalysisException:
            found = None
        self.live = bool(found and found["format"] == FORMAT and found["root"] == root)
        self.threshold, self.buckets = (found["threshold"], found["buckets"]) if self.live else (None, 0)

    def rows(self, terms: list[str]) -> DataFrame:
        """(term, name) of the asked terms, read from their buckets only; for a live index."""
        table = self.spark.read.schema("term string, name string, bucket int").parquet(f"{self.path}/cones")
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        numbers = [r[0] for r in asked.select(_bucket("term", self.buckets)).distinct().collect()]
        return table.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms)).select("term", "name")

    def cones(self, edges: DataFrame, terms: list[str]) -> DataFrame:
        """(term, name): the cones of the terms, from the index where it has them, walked where it has not."""
        walk = self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
        if not self.live:
            return cones(edges, walk)
        held = materialize(self.rows(sorted(set(terms))))
        # a category below the threshold is not in the index: it is narrow, so its walk is short
        narrow = materialize(walk.join(held.select("term").distinct(), "term", "left_anti"))
        return held if narrow.isEmpty() else held.unionByName(cones(edges, narrow))


def conjunction(edges: DataFrame, terms: list[str], index: ConeIndex | None = None) -> DataFrame:
    """(name) below all terms, cones from the index where one is given."""
    wanted = sorted(set(terms) - {"*"})
    if not wanted:
        return names(edges)
    found = index.cones(edges, wanted) if index else cones(edges, edges.sparkSession.createDataFrame([(t,) for t in wanted], "term string"))
    return found.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("name")


def plan(counts: DataFrame, terms: list[str], depth: int = 8) -> tuple[list[str], str]:
    """(terms, smallest cone first; "probe" or "walk") from counts (name, n): only the smallest cone is enumerated and its
    names are probed upwards, at about `depth` steps a name, when that is less than walking the other cones."""
    known = {r["name"]: r["n"] for r in counts.where(F.col("name").isin(terms)).select("name", "n").collect()}  # a row a term
    order = sorted(terms, key=lambda t: (known.get(t, 0), t))
    rest = sum(known.get(t, 0) for t in order[1:])
    return order, "probe" if len(order) > 1 and known.get(order[0], 0) * depth < rest else "walk"


def planned_conjunction(index: EdgeIndex, counts: DataFrame, terms: list[str], depth: int = 8) -> DataFrame:
    """(name) below all terms, by the cheaper of the two ways; walks read only the buckets that they meet. A term without a
    count is unknown, so nothing is below it."""
    wanted = sorted(set(terms) - {"*"})
    spark = counts.sparkSession
    if not wanted:
        raise ValueError("a planned query needs a term")
    order, way = plan(counts, wanted, depth)
    start = lambda ts: spark.createDataFrame([(t,) for t in ts], "term string")
    if way == "walk":
        return cones(index.down, start(order)).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(order)).select("name")
    least = cones(index.down, start(order[:1])).select("name")
    above = cones(index.up, least.select(F.col("name").alias("term"))).where(F.col("name").isin(order[1:]))
    return above.groupBy(F.col("term").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") == len(order) - 1).select("name")


def optimised_supers(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """(item, parent): where an item belongs whose given categories are `batch` (item, parent).

    The given categories and all above them are its elements; a name all of whose ancestors are among the elements joins
    them, again and again until none does (a division of the ancestor pairs by the elements); the item goes
    under the elements that have no child at all; without any, it goes under the root."""
    claims = batch.select("item", "parent").distinct()
    up = materialize(ancestors_of(edges, claims.select(F.col("parent").alias("term"))))
    have = claims.select("item", F.col("parent").alias("name")).union(claims.join(up, claims["parent"] == up["term"]).select("item", "name")).where("name <> '*'").distinct()
    have = materialize(have)
    # all ancestors are elements just when all parents are: those elements' own ancestors are elements already
    needs = edges.where("parent <> '*'").groupBy("child").agg(F.count("*").alias("needs"))
    fresh = have
    while True:
        near = edges.join(fresh.select("item", F.col("name").alias("parent")), "parent").select("item", "child").distinct().join(have.select("item", F.col("name").alias("child")), ["item", "child"], "left_anti")
        met = near.join(edges, "child").join(have.select("item", F.col("name").alias("parent")), ["item", "parent"]).groupBy("item", "child").agg(F.count("*").alias("n"))
        fresh = materialize(met.join(needs, "child").where("n = needs").select("item", F.col("child").alias("name")))
        if fresh.isEmpty():
            break
        have = materialize(have.unionByName(fresh))
    leaves = have.join(edges.select(F.col("parent").alias("name")).distinct(), "name", "left_anti").select("item", F.col("name").alias("parent"))
    alone = claims.select("item").distinct().join(leaves, "item", "left_anti").select("item", F.lit("*").alias("parent"))
    return leaves.where("item <> parent").unionByName(alone)
