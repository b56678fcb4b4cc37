"""Versions by difference: records in content-addressed group files under a fingerprint tree.

A record's group is the beginning of its name's SHA-256, so it stays in its group whatever its parents are. A group's
fingerprint is over its records' fingerprints, sorted; a node's over its sixteen children's; the root names the version,
and equal graphs have equal roots whatever their history. A store is a folder: groups/leaf=<group>/hash=<fingerprint>/ holds a
group's records, written when some version first has them and never changed; trees/root=<root>/ lists a version's groups, a
row each; heads/number=<n>/ says which version is current.

A commit writes only groups that the store has not yet, a difference reads only groups that differ, and a batch reads
and rewrites only the groups of its names. Groups are the unit, so their number, 16 ** digits, should grow with the graph.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .versions import changed, record_hashes

RECORD = "name string, up array<string>, hash string"
KEY = ["parent", "child"]


def _edges(records: DataFrame) -> DataFrame:
    return records.select(F.explode("up").alias("parent"), F.col("name").alias("child"))


class GroupStore:
    def __init__(self, spark: SparkSession, path: str, digits: int = 3) -> None:
        self.spark, self.path, self.digits = spark, path, digits

    def _leaf(self, name: str) -> Column:
        return F.substring(F.sha2(F.col(name), 256), 1, self.digits)

    def leaves(self, root: str | None) -> DataFrame:
        """(leaf, hash): the groups of a version; none of no version."""
        empty = self.spark.createDataFrame([], "leaf string, hash string")
        return empty if root is None else self.spark.read.schema("leaf string, hash string").parquet(f"{self.path}/trees/root={root}")

    def _root(self, groups: DataFrame) -> str:
        """The root over (leaf, hash): level by level, sixteen children a node at most."""
        level = groups.select(F.col("leaf").alias("at"), "hash")
        for n in range(self.digits - 1, -1, -1):
            children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat(x["at"], x["hash"])), "\n")
            level = level.groupBy(F.substring("at", 1, n).alias("up")).agg(F.sha2(children, 256).alias("hash")).select(F.col("up").alias("at"), "hash")
        found = level.first()
        return found["hash"] if found else ""

    def _groups(self, records: DataFrame) -> DataFrame:
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256)
        return records.groupBy(self._leaf("name").alias("leaf")).agg(digest.alias("hash"))

    def _save(self, records: DataFrame, groups: DataFrame, whole: DataFrame) -> str:
        """Write the `groups` of `records`, then the tree of the version with the groups `whole`; its root."""
        if not groups.isEmpty():
            rows = records.withColumn("leaf", self._leaf("name")).join(groups.withColumnRenamed("hash", "group"), "leaf")
            # the folder is named by the group's `hash`, so the record's own is stored as `mark`
            rows = rows.select("name", "up", F.col("hash").alias("mark"), "leaf", F.col("group").alias("hash"))
            rows.repartition("leaf").sortWithinPartitions("leaf", "name").write.mode("append").partitionBy("leaf", "hash").parquet(f"{self.path}/groups")
        root = self._root(whole)
        if not self._has(root):
            whole.select("leaf", "hash").coalesce(1).sortWithinPartitions("leaf").write.mode("error").parquet(f"{self.path}/trees/root={root}")
        return root

    def _has(self, root: str) -> bool:
        try:
            self.spark.read.schema("leaf string, hash string").parquet(f"{self.path}/trees/root={root}").limit(1).count()
            return True
        except AnalysisException:
            return False

    def known(self, leaves: DataFrame) -> DataFrame:
        """Those of (leaf, hash) that some version of the store has."""
        try:
            every = self.spark.read.schema("leaf string, hash string, root string").parquet(f"{self.path}/trees")
        except AnalysisException:
            return leaves.limit(0)
        return leaves.join(every.select("leaf", "hash").distinct(), ["leaf", "hash"], "left_semi")

    def commit(self, edges: DataFrame) -> str:
        """Make a version of a whole graph; only groups that the store lacks are written."""
        records = materialize(record_hashes(edges))
        whole = materialize(self._groups(records))
        fresh = materialize(whole.join(self.known(whole), ["leaf", "hash"], "left_anti"))
        return self._point(self._save(records, fresh, whole))

    def commit_batch(self, added: DataFrame, removed: DataFrame | None = None) -> str:
        """Make a version of the current one with edges (parent, child) added and removed; only the groups of
        their children are read and written. A name left without parents goes."""
        head = self.head()
        old = self.leaves(head)
        ends = added.select(*KEY) if removed is None else added.select(*KEY).union(removed.select(*KEY))
        touched = materialize(ends.select(self._leaf("child").alias("leaf")).distinct())
        before = old.join(touched, "leaf", "left_semi")
        edges = _edges(self.records(before)).unionByName(added.select(*KEY)).distinct()
        edges = edges if removed is None else edges.join(removed.select(*KEY), KEY, "left_anti")
        records = materialize(record_hashes(edges))
        groups = materialize(self._groups(records))
        whole = materialize(old.join(touched, "leaf", "left_anti").unionByName(groups))
        fresh = materialize(groups.join(self.known(groups), ["leaf", "hash"], "left_anti"))
        return self._point(self._save(records, fresh, whole))

    def records(self, groups: DataFrame) -> DataFrame:
        """(name, up, hash) of the given groups."""
        paths = [f"{self.path}/groups/leaf={r['leaf']}/hash={r['hash']}" for r in groups.select("leaf", "hash").collect()]  # a row a group
        if not paths:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema("name string, up array<string>, mark string").parquet(*paths).select("name", "up", F.col("mark").alias("hash"))

    def load(self, root: str) -> DataFrame:
        """The edges of a version; ValueError for one that the store has not."""
        if not self._has(root):
            raise ValueError(f"no version {root!r}")
        return _edges(self.records(self.leaves(root)))

    def differing(self, a: str | None, b: str | None, other: GroupStore | None = None) -> tuple[DataFrame, DataFrame]:
        """(groups of a, groups of b), each (leaf, hash), that the other version has not; b may lie in another store."""
        mine, theirs = materialize(self.leaves(a)), materialize((other or self).leaves(b))
        return mine.join(theirs, ["leaf", "hash"], "left_anti"), theirs.join(mine, ["leaf", "hash"], "left_anti")

    def diff(self, a: str, b: str) -> DataFrame:
        """(name, change): records added, removed or changed from version a to version b."""
        mine, theirs = self.differing(a, b)
        return changed(self.records(mine), self.records(theirs))

    def head(self) -> str | None:
        """The current version; None in a new store."""
        try:
            rows = self.spark.read.schema("root string, number long").parquet(f"{self.path}/heads").collect()  # a row a commit
        except AnalysisException:
            return None
        return max(rows, key=lambda r: r["number"])["root"] if rows else None

    def _point(self, root: str) -> str:
        """Make a version current, in a folder that only one writer can make: the other of two at once fails."""
        try:
            last = self.spark.read.schema("root string, number long").parquet(f"{self.path}/heads").agg(F.max("number"), F.max_by("root", "number")).first()
        except AnalysisException:
            last = (0, None)
        if root != last[1]:
            self.spark.createDataFrame([(root,)], "root string").coalesce(1).write.mode("error").parquet(f"{self.path}/heads/number={(last[0] or 0) + 1}")
        return root

    def fold(self, other: GroupStore, root: str) -> str:
        """Take over what a peer's version claims and ours does not; nothing of ours goes. Only groups that
        differ are read. In any order, and repeated, the same peers' versions end in the same root."""
        if root == self.head():
            return root
        mine, theirs = self.differing(self.head(), root, other)
        news = _edges(other.records(theirs)).join(_edges(self.records(mine)), KEY, "left_anti")
        news = materialize(news)
        return self.head() if news.isEmpty() and self.head() is not None else self.commit_batch(news)
