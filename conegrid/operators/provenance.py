"""Who said what about which claim, and proofs that a version of a graph entails a claim.

An act (subject, author, act, basis, at, origin) is append-only; its key is a fingerprint of all of it,
so stores unite by key. A certificate holds a chain of records from a name up to another, each with the
fingerprints that lead from it to the version's root; whoever has only the root can verify it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .versions import record_hashes

ACTS = ("assert", "endorse", "retract", "bind")
FIELDS = ["subject", "author", "act", "basis", "at", "origin"]


def subjects(claims: DataFrame) -> DataFrame:
    """Claims (sub, sup) with subject, the fingerprint that acts name them by; a null sup claims that the
    name exists."""
    return claims.withColumn("subject", F.sha2(F.to_json(F.array("sub", F.coalesce("sup", F.lit("*")))), 256))


def acts(rows: DataFrame) -> DataFrame:
    """Acts with their key, each once. An act of no known type stops the query."""
    known = F.when(F.col("act").isin(*ACTS), F.col("act")).otherwise(F.raise_error(F.concat(F.lit("no such act: "), F.coalesce("act", F.lit("null")))))
    whole = rows.select(*[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]).withColumn("act", known)
    return whole.withColumn("key", F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["key"])


def unite(*stores: DataFrame) -> DataFrame:
    """The acts of several stores, each once."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["key"])


def about(store: DataFrame, claims: DataFrame) -> DataFrame:
    """The acts on the claims (sub, sup), oldest first."""
    return store.join(subjects(claims).select("sub", "sup", "subject").distinct(), "subject").orderBy("at", "key")


def prove_below(edges: DataFrame, sub: str, sup: str) -> list[dict] | None:
    """A certificate that `sub` is below `sup`: the records of a shortest chain; None if it is not.

    Only a chain's records and the fingerprints of their groups reach the driver."""
    spark, records = edges.sparkSession, materialize(record_hashes(edges))
    front = spark.createDataFrame([(sub, [sub])], "name string, chain array<string>")
    seen, chain = front.select("name"), [sub] if sub == sup and not records.where(F.col("name") == sub).isEmpty() else None
    while chain is None:
        step = front.join(edges, front["name"] == edges["child"]).select(F.col("parent").alias("name"), F.concat("chain", F.array("parent")).alias("chain"))
        front = materialize(step.groupBy("name").agg(F.min("chain").alias("chain")).join(seen, "name", "left_anti"))
        if front.isEmpty():
            return None
        seen = seen.union(front.select("name"))
        hit = front.where(F.col("name") == sup).select("chain").collect()  # one row at most
        chain = list(hit[0][0]) if hit else None
    grouped = records.groupBy(F.substring("hash", 1, 3).alias("g")).agg(F.array_sort(F.collect_list("hash")).alias("hashes")).withColumn("digest", F.sha2(F.array_join("hashes", ""), 256))
    grouped = materialize(grouped)
    tops = sorted(r[0] for r in grouped.select("digest").collect())  # at most 4,096 fingerprints
    mine = records.where(F.col("name").isin(chain[:-1] if len(chain) > 1 else chain)).join(grouped, F.substring("hash", 1, 3) == F.col("g"))
    found = {r["name"]: r for r in mine.collect()}  # a row a step of the chain
    order = [n for n in chain if n in found]
    return [{"name": n, "up": list(found[n]["up"]), "group": list(found[n]["hashes"]), "tops": tops} for n in order]


def verify_below(certificate: list[dict], root: str, sub: str, sup: str) -> bool:
    """Whether a certificate proves, to one who knows only the root, that `sub` is below `sup`."""
    digest = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    at = sub
    for i, r in enumerate(certificate or []):
        mark = hashlib.sha256((r["name"] + "\n" + json.dumps(r["up"], ensure_ascii=False, separators=(",", ":"))).encode()).hexdigest()
        sound = r["name"] == at and mark in r["group"] and digest(r["group"]) in r["tops"] and digest(r["tops"]) == root
        if not sound:
            return False
        following = certificate[i + 1]["name"] if i + 1 < len(certificate) else sup
        if following in r["up"]:
            at = following
        elif not (sub == sup == at and len(certificate) == 1):
            return False
    return bool(certificate) and at == sup
