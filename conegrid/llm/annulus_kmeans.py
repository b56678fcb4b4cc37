"""Integer k-means whose assignment searches an annulus of centroid norms.

A centroid within u of a vector has a norm within u of the vector's norm. So centroids are sorted by
norm, u is the distance to the centroid that the vector had in the round before (in the first round, to the one
nearest in norm), a binary search finds the run of norms within the annulus, and only that run is
compared, exactly, in integers; ties on the annulus' border or in distance are inside it, and the
smaller centroid number wins.

A round is one scan: tasks assign blocks of vectors and add up their members, so only sums a task and
centroid are shuffled, and no cluster is ever one group. Centroids, clusters x components integers with both
numbers parameters, are all that reaches the driver or is broadcast. The vectors with their clusters are written to the
shared folder every round, which is what the next round's bound is taken from.

Vectors that are null, of another length, or hold null or non-finite components take no part. A vector without a
vec_id is assigned and counted but cannot be a first centroid; repeated rows are vectors of their own.
With fewer vectors than clusters there are fewer centroids; an empty table gives no rows. Components too
large for 64-bit distances are refused. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Integers that centroids may hold together: they are broadcast.
LARGEST_TABLE = 1 << 24
#: Distances that a task holds at once.
BLOCK = 1 << 22


class Annulus:
    """Centroids sorted by norm, and the exact nearest one of each vector."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.table = norms[self.number], centroids[self.number]
        self.place = np.empty(len(centroids), np.int64)
        self.place[self.number] = np.arange(len(centroids))

    def nearest(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of x; last: the row's centroid so far, or -1."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        guess = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        at = np.where(last >= 0, self.place[np.maximum(last, 0)], guess)
        best = ((x - self.table[at]) ** 2).sum(1)
        number = self.number[at]
        # norms are rounded, so the annulus is widened by far more than their error
        reach = np.sqrt(best.astype(np.float64)) + 1e-9 * (norm + self.norms[-1] + 1)
        lo, hi = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        step = 64  # neighbours in norm that are compared together
        for first in range(0, len(self.norms), step):
            block = self.table[first : first + step]
            rows = np.flatnonzero((lo < first + len(block)) & (hi > first))
            for part in np.array_split(rows, max(1, -(-len(rows) * block.size // BLOCK))):
                if not len(part):
                    continue
                places = first + np.arange(len(block))
                d = ((x[part][:, None, :] - block[None]) ** 2).sum(2)
                inside = (places >= lo[part, None]) & (places < hi[part, None])
                d = np.where(inside, d, np.iinfo(np.int64).max)
                least = d.min(1)
                who = np.where(d == least[:, None], self.number[places], np.iinfo(np.int64).max).min(1)
                better = (least < best[part]) | (least == best[part]) & (who < number[part])
                best[part], number[part] = np.where(better, least, best[part]), np.where(better, who, number[part])
        return number, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64, copy=False)


def _assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance): every vector's nearest centroid; `vectors` has the cluster of the round before."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Annulus(shared.value)
        for batch in batches:
            number, best = index.nearest(_matrix(batch.column("v"), dim), batch.column("cluster").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long")


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of every cluster's mean; empty clusters keep their centroid."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # components are below 2**31 (cluster() refuses others), so a task's sums fit
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, c = _matrix(batch.column("v"), dim), batch.column("cluster").to_numpy(zero_copy_only=False)
                order = np.argsort(c, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
                total[c[order][cuts]] += np.add.reduceat(x[order], cuts)
                n += np.bincount(c, minlength=k)
        who, at = np.repeat(np.flatnonzero(n), dim), np.tile(np.arange(dim), np.count_nonzero(n))
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[who]), pa.array(total[who, at])], ["cluster", "place", "n", "s"])

    sums = assigned.select("v", "cluster").mapInArrow(add, "cluster int, place int, n long, s long")
    summed = sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = centroids.copy()
    for number, place, n, s in summed.collect():  # at most clusters x components rows
        found[number, place] = int(s) // n  # rounds down
    return found


def cluster(vectors: DataFrame, dim: int, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every integer vector
    (vec_id, v) of `dim` components.

    The first centroids are the vectors with the smallest SHA-256 of `seed:vec_id`.
    """
    if clusters * dim > LARGEST_TABLE:
        raise ValueError(f"{clusters} centroids of {dim} components are over the bound of what is broadcast")
    spark = vectors.sparkSession
    now = materialize(vectors.where(F.size("v") == dim).select("vec_id", "v", F.lit(-1).alias("cluster")))
    largest = now.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if largest is not None and dim * (2 * int(largest) + 1) ** 2 >= 1 << 63:
        raise ValueError("components too large: distances would not fit into 64-bit integers")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = now.where("vec_id is not null").orderBy(mark, "v").limit(clusters).collect()
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        before, now = now, materialize(_assign(now, centroids))
        discard(before)
        centroids = _means(now, centroids)
    found = materialize(_assign(now, centroids).select("vec_id", "cluster", "distance"))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    total = sum(inertia.values())
    rows = [(i, inertia[i], total, digest(c)) for i, c in enumerate(centroids) if i in inertia]  # a row a cluster
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_embeddings(rows: DataFrame, dim: int = 64, scale: int = 1024, **settings) -> DataFrame:
    """`cluster` of the usable vectors in (vec_id, embedding), every component x as floor(scale * x)."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite)
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return cluster(usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), dim, **settings)
