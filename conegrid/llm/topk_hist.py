"""Exact top-k by distributed histogram selection.

Integer vectors are scored against every candidate in blocks of a matrix product. The scores are not
kept: a pass counts them per query in equal bins of the query's current score interval; summed over
all tasks, the counts tell the bin with the kth score, which becomes the next interval, until few
enough scores are at or above its lower end or it is one score wide. A last pass keeps the scores at
or above each query's threshold, a task's k best of them, and a window ranks what is left with ties
going to the smaller id. Queries are taken in waves of a fixed number and number of bytes, and candidates
in blocks, so what is broadcast and what a task holds have fixed bounds.

Vectors that are null or hold null or non-finite components take no part; scores that could not fit into
64-bit integers are refused. Query and candidate must
have as many components to be scored. A candidate with the query's own id is the query's own row;
a repeated query id is answered once, by its greatest vector; repeated candidates (same id) all count.
Fewer than k candidates: all are returned. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BINS = 256
#: Bounds of what is broadcast, and of the queries counted for, at once.
WAVE_BYTES = 32 << 20
WAVE = 16_384
#: Scores that a task holds at once.
BLOCK = 1 << 22


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * component) of each usable vector, as 64-bit integers."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _blocks(batches: Iterator[pd.DataFrame], dim: int, queries: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = max(1, min(2048, BLOCK // max(1, queries)))
    for pdf in batches:
        keep = pdf[pdf["v"].map(len) == dim]
        for lo in range(0, len(keep), rows):
            part = keep.iloc[lo : lo + rows]
            yield part["vec_id"].to_numpy(np.int64), np.array(part["v"].tolist(), kind).reshape(len(part), dim)


def _wave(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, largest: float) -> DataFrame:
    """Scores at or above each query's kth, at most k per task and query.

    Sums that stay below 2**53 are exact as doubles; larger ones are taken as 64-bit integers."""
    sc, dim = vectors.sparkSession.sparkContext, q.shape[1]
    bound = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * largest * (1 + 1e-9)
    if not (bound < 2.0**61).all():
        raise ValueError("vectors too long: scores would not fit into 64-bit integers")
    kind = np.float64 if (bound < 2.0**53).all() else np.int64
    q, reach = q.astype(kind), np.ceil(bound).astype(np.int64) + 1
    low, width, above = -reach, 2 * reach + 1, np.zeros(len(ids), np.int64)
    live = np.ones(len(ids), bool)
    shared = sc.broadcast((ids, q))
    while live.any():
        at = sc.broadcast((np.flatnonzero(live), low[live], -(-width[live] // BINS)))

        def count(batches: Iterator[pd.DataFrame], at=at) -> Iterator[pd.DataFrame]:
            (own, mat), (rows, lo, step) = shared.value, at.value
            total = np.zeros((len(rows), BINS + 1), np.int64)
            for cand, x in _blocks(batches, dim, len(rows), kind):
                bins = ((mat[rows] @ x.T).astype(np.int64) - lo[:, None]) // step[:, None]
                bins = np.where((bins < 0) | (bins >= BINS) | (own[rows][:, None] == cand), BINS, bins)
                flat = bins + np.arange(len(rows))[:, None] * (BINS + 1)
                total += np.bincount(flat.ravel(), minlength=total.size).reshape(total.shape)
            r, b = np.nonzero(total[:, :BINS])
            yield pd.DataFrame({"r": rows[r], "b": b, "n": total[r, b]})

        counted = vectors.mapInPandas(count, "r long, b long, n long").groupBy("r", "b").agg(F.sum("n").alias("n"))
        # running sums from the top bin down; the first to reach k holds the kth score
        down = Window.partitionBy("r").orderBy(F.desc("b"))
        sums = counted.withColumn("upto", F.sum("n").over(down))
        need = sc.broadcast(dict(zip(np.flatnonzero(live).tolist(), (k - above[live]).tolist(), strict=True)))
        missing = F.pandas_udf(lambda r: r.map(need.value), "long")
        kth = sums.where(F.col("upto") >= missing("r")).groupBy("r").agg(F.max_by(F.struct("b", "n", "upto"), "b").alias("x")).select("r", "x.*")
        seen = {int(r): (int(b), int(n), int(upto)) for r, b, n, upto in kth.collect()}  # one row a query of this wave
        for r in np.flatnonzero(live):
            step = -(-width[r] // BINS)
            if r not in seen:  # fewer candidates than k: all are kept
                live[r], low[r] = False, -reach[r]
                continue
            b, n, upto = seen[r]
            low[r], width[r] = low[r] + b * step, step
            done = above[r] + upto <= 4 * k or step == 1
            above[r] += upto - n
            live[r] = not done

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, mat = shared.value
        best: list[tuple[np.ndarray, ...]] = []
        for cand, x in _blocks(batches, dim, len(own), kind):
            s = (mat @ x.T).astype(np.int64)
            r, c = np.nonzero((s >= floor.value[:, None]) & (own[:, None] != cand))
            best.append((r, cand[c], s[r, c]))
            if sum(len(b[0]) for b in best) > 1_000_000:
                best = [_first(best, k)]
        r, c, s = _first(best, k)
        yield pd.DataFrame({"query_id": own[r], "vec_id": c, "score": s})

    floor = sc.broadcast(low)
    return vectors.mapInPandas(keep, "query_id long, vec_id long, score long")


def _first(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best of the gathered (query row, candidate, score)."""
    r, c, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k], s[rank < k]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by integer inner product."""
    vectors = materialize(vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism))
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("d", F.size("v"))
    dims = queries.groupBy("d").agg(F.count("*").alias("n")).collect()  # a row for each length of vector
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    out = None
    for d, n in sorted(tuple(x) for x in dims):
        largest = vectors.where(F.size("v") == d).agg(F.max(norm)).first()[0]
        waves = max(1, -(-n * (8 * d + 8) // WAVE_BYTES), -(-n // WAVE))
        for w in range(waves):
            mine = queries.where((F.col("d") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w)).toPandas()  # about WAVE_BYTES
            if len(mine):
                got = _wave(vectors, mine["vec_id"].to_numpy(np.int64), np.array(mine["v"].tolist(), np.int64).reshape(len(mine), d), k, largest)
                out = got if out is None else out.unionAll(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
