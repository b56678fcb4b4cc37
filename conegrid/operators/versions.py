"""Versions of a graph: records with fingerprints, snapshots that never change, history, differences.

A record is a name with its sorted parents; its fingerprint is the SHA-256 of the two, and a graph's
root is the SHA-256 over the sorted fingerprints of 4,096 groups of records, each in turn over its
records' sorted fingerprints, so that no task or group holds them all and equal graphs have equal
roots whatever their layout. A store is a folder: root=<root>/ with a snapshot's records, and log/ with
a row a commit, undo or redo.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import merge

LOG = "number long, kind string, root string, message string, steps int, at string"


def record_hashes(edges: DataFrame) -> DataFrame:
    """(name, up, hash): each name's sorted parents, and the fingerprint of the name and them."""
    up = edges.groupBy(F.col("child").alias("name")).agg(F.array_sort(F.collect_set("parent")).alias("up"))
    return up.withColumn("hash", F.sha2(F.concat("name", F.lit("\n"), F.to_json("up")), 256))


def root_of(records: DataFrame, groups_bits: int = 12) -> str:
    """The fingerprint of all records; of nothing for an empty graph."""
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    groups = records.groupBy(F.substring("hash", 1, groups_bits // 4).alias("g")).agg(digest("hash").alias("h"))
    return groups.agg(digest("h")).first()[0]


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): names whose records were added, removed or changed between two record tables."""
    both = before.select("name", F.col("hash").alias("old")).join(after.select("name", F.col("hash").alias("new")), "name", "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("name", kind.alias("change"))


def _log(spark: SparkSession, store: str) -> list:
    """The store's log in order; a row a commit, undo or redo. Reading writes nothing."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{store}/log").collect()
    except AnalysisException:  # a new store has no log yet
        return []
    return sorted(rows, key=lambda r: r["number"])


def _line(log: list) -> tuple[list, int]:
    """(commits that undo and redo move along, place of the current one); a commit after an undo drops
    what was undone from the line. A place of -1 is before all commits."""
    line, at = [], -1
    for r in log:
        if r["kind"] == "commit":
            line, at = [*line[: at + 1], r], at + 1
        else:
            at += r["steps"] if r["kind"] == "redo" else -r["steps"]
    return line, at


def _append(spark: SparkSession, store: str, log: list, kind: str, root: str, message: str, steps: int = 0) -> None:
    """One more row, in a folder that only one writer can make: the other of two at once fails."""
    number = log[-1]["number"] + 1 if log else 1
    row = (number, kind, root, message, steps, datetime.now(timezone.utc).isoformat(timespec="seconds"))
    spark.createDataFrame([row], LOG).coalesce(1).drop("number").write.mode("error").parquet(f"{store}/log/number={number}")


def history(spark: SparkSession, store: str, most: int | None = None) -> DataFrame:
    """(number, root, message, at, current): the commits of the line, newest first, at most so many."""
    line, at = _line(_log(spark, store))
    rows = [(r["number"], r["root"], r["message"], r["at"], i == at) for i, r in enumerate(line)][::-1]
    return spark.createDataFrame(rows[:most], "number long, root string, message string, at string, current boolean").orderBy(F.desc("number"))


def head(spark: SparkSession, store: str) -> tuple[int, str | None]:
    """(number, root) of the current version; (0, None) in a new store."""
    line, at = _line(_log(spark, store))
    return (line[at]["number"], line[at]["root"]) if at >= 0 else (0, None)


def status(edges: DataFrame, store: str) -> DataFrame:
    """(name, change): what `edges` has other than the current version."""
    spark, (_, root) = edges.sparkSession, head(edges.sparkSession, store)
    ours = record_hashes(edges)
    return changed(ours.limit(0) if root is None else record_hashes(load_at(spark, store, root)), ours)


def commit(edges: DataFrame, store: str, message: str = "") -> str:
    """Write a snapshot unless it is there, and point the store to it; an unchanged graph makes no version."""
    spark, records = edges.sparkSession, record_hashes(edges)
    root = root_of(records)
    log = _log(spark, store)
    if root != head(spark, store)[1]:
        if root not in {r["root"] for r in log}:
            records.write.mode("overwrite").parquet(f"{store}/root={root}")  # of a commit that failed, if it was there
        _append(spark, store, log, "commit", root, message)
    return root


def resolve(spark: SparkSession, store: str, prefix: str) -> str:
    """The one root that begins with `prefix`; ValueError if none or several do."""
    found = {r["root"] for r in _log(spark, store) if r["root"].startswith(prefix)}
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} version begins with {prefix!r}")
    return found.pop()


def load_at(spark: SparkSession, store: str, prefix: str) -> DataFrame:
    """The edges of a version, by its root or a unique beginning of it."""
    rows = spark.read.schema("name string, up array<string>, hash string").parquet(f"{store}/root={resolve(spark, store, prefix)}")
    return rows.select(F.explode("up").alias("parent"), F.col("name").alias("child"))


def _step(spark: SparkSession, store: str, kind: str, steps: int) -> str:
    log = _log(spark, store)
    line, at = _line(log)
    to = at + (steps if kind == "redo" else -steps)
    if steps < 1 or not 0 <= to < len(line):
        raise ValueError(f"nothing to {kind}")
    _append(spark, store, log, kind, line[to]["root"], "", steps)
    return line[to]["root"]


def undo(spark: SparkSession, store: str, steps: int = 1) -> str:
    """Point the store so many commits back; ValueError where there are not so many."""
    return _step(spark, store, "undo", steps)


def redo(spark: SparkSession, store: str, steps: int = 1) -> str:
    """Point the store so many undone commits forward; a commit in between leaves nothing to redo."""
    return _step(spark, store, "redo", steps)


def sync(edges: DataFrame, other: DataFrame) -> DataFrame:
    """`edges` with a peer's claims folded in: only its differing records are merged; what the peer
    lacks stays, and equal graphs are left as they are."""
    ours, theirs = record_hashes(edges), record_hashes(other)
    differ = theirs.join(ours.select("name", "hash"), ["name", "hash"], "left_anti")
    news = differ.select(F.explode("up").alias("parent"), F.col("name").alias("child"))
    return edges if news.isEmpty() else merge(edges, news)


def reclassified(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name) in both closures (ancestor, descendant), but with other ancestors."""
    sets = [c.groupBy(F.col("descendant").alias("name")).agg(F.array_sort(F.collect_set("ancestor")).alias("a")) for c in (before, after)]
    return sets[0].join(sets[1].withColumnRenamed("a", "b"), "name").where("a <> b").select("name")


def recoded(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name) in both tables of codes (name, code), but with other ancestors."""
    return before.join(after.select("name", F.col("code").alias("_code")), "name").where("code <> _code").select("name")


def standing(acts: DataFrame, trusted: list[str]) -> DataFrame:
    """(subject, accepted) of verified acts (subject, author, act): a subject is accepted if a trusted
    author asserted it and never retracted it, whatever the order."""
    mine = acts.where(F.col("author").isin(trusted)).groupBy("subject", "author").agg(F.collect_set("act").alias("acts"))
    stands = mine.withColumn("ok", F.array_contains("acts", "assert") & ~F.array_contains("acts", "retract"))
    accepted = stands.groupBy("subject").agg(F.bool_or("ok").alias("accepted"))
    return acts.select("subject").distinct().join(accepted, "subject", "left").select("subject", F.coalesce("accepted", F.lit(False)).alias("accepted"))
