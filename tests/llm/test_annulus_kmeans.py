import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conegrid.llm import annulus_kmeans

ROWS = "vec_id long, embedding array<double>, cluster string"


def brute(rows, dim, scale, clusters, rounds, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:clusters]]
    if not cents:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, k) in zip(kept, at) if k == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(str((i, j, d, sum(x for x, k in at if k == j), sum(x for x, _ in at), digest[j])) for (i, _), (d, j) in zip(kept, at))


@pytest.mark.parametrize("clusters", [3, 70])
def test_clusters_match_brute_force(spark, clusters):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (6, 4))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.5, 4)).tolist()) for i in range(150)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (500, [0.5, -0.5, 0.25, 0.0]), (501, [0.5, -0.5, 0.25, 0.0]), (502, None), (503, [1.0, None, 0.0, 0.0]), (504, [1.0]), (505, [float("nan")] * 4), (506, [float("inf")] * 4)]
    frame = spark.createDataFrame([(i, v, "own") for i, v in rows], ROWS)
    got = annulus_kmeans.cluster_embeddings(frame, dim=4, scale=4, clusters=clusters, rounds=4, seed=9)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 4, 4, clusters, 4, 9)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], ROWS)
    got = annulus_kmeans.cluster_embeddings(frame, dim=2, scale=1, clusters=8).collect()
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in got} == {(1, 0, 0), (2, 0, 0)}
    assert annulus_kmeans.cluster_embeddings(frame.where(F.lit(False)), dim=2).count() == 0


def test_candidates_come_from_the_annulus_with_its_border():
    cents = np.array([[10, 0], [0, 10], [-10, 0], [3, 0], [100, 0]], np.int64)
    index = annulus_kmeans.Annulus(cents)
    x = np.array([[0, 0], [5, 5], [-10, 0], [55, 0], [6, 0]], np.int64)
    for last in (np.full(5, -1), np.array([4, 4, 4, 4, 4]), np.array([2, 1, 0, 3, 0])):
        number, d = index.nearest(x, last)
        assert list(zip(d.tolist(), number.tolist())) == [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(cents)) for v in x]


def test_too_large_is_refused(spark):
    frame = spark.createDataFrame([(1, [1e12, 0.0], "")], ROWS)
    with pytest.raises(ValueError):
        annulus_kmeans.cluster_embeddings(frame, dim=2)
    with pytest.raises(ValueError):
        annulus_kmeans.cluster_embeddings(frame, dim=2, clusters=1 << 24)
