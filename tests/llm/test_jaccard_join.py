import numpy as np
import pytest
from pyspark.sql import functions as F

from conegrid.llm import jaccard_join

DOCS = "doc_id long, text string, cell string, node string"


def shingles(text, k=3):
    w = [x for x in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def brute(rows, num, den):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        out.append(str((d, len(sets[i]), min((x for x in own if x is not None), default=None))))
    return sorted(out)


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n ", "one", "One ", "one two", "a b c", "A b\tc d", "é ü ö " * 30, "x " * 500, "y" * 3000]
    for family in range(6):  # chains: each copy has one more word of its own, so far ends do not link
        w = [f"f{family}w{i}" for i in range(40 + 60 * family)]
        for step in range(14):
            w[int(rng.integers(len(w)))] = f"own{family}-{step}"
            texts.append(" ".join(w[: len(w) - step % 3]))
    shared = [f"s{i}" for i in range(60)]
    for i in range(30):  # a passage that many share, without being near copies
        texts.append(" ".join([*shared, *(f"u{i}-{j}" for j in range(10 + i))]))
    texts += [" ".join(f"n{i}" for i in range(n)) for n in range(8, 40)]  # neighbouring sizes
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    return [*rows, rows[12], rows[12], (None, rows[20][1]), (None, "nobody else has this text at all"), (3, "another text under a known id here")]


@pytest.mark.parametrize("num, rows, tokens", [(90, 4000, 1 << 21), (80, 5, 300)])
def test_components_match_brute_force(spark, num, rows, tokens):
    data = corpus()
    frame = spark.createDataFrame([(i, t, "own", "x") for i, t in data], DOCS)
    got = jaccard_join.jaccard_components(frame, 3, num, 100, rows, tokens)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(data, num, 100)


def test_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    frame = spark.createDataFrame([(1, None, "", ""), (2, "", "", "")], DOCS)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(frame).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_linked_sets_always_share_a_cell():
    bands, rng = jaccard_join.Bands(90, 100), np.random.default_rng(0)
    for _ in range(300):
        n = int(np.exp(rng.uniform(2, 7)))
        both = rng.integers(0, 1 << 63, n, np.uint64)
        room = int(n * 0.11)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, int(rng.integers(room + 1)), np.uint64)]) for _ in range(2))
        if 100 * n >= 90 * (len(a) + len(b) - n) and len(a) + len(b) > 2 * n:
            assert np.intersect1d(bands.cells(np.unique(a)), bands.cells(np.unique(b))).size


@pytest.mark.parametrize("seed", range(2))
def test_regions_are_joined_exactly(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(10_000, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(b, int(rng.integers(50, 61)), replace=False), rng.integers(0, 10_000, int(rng.integers(4)))])) for b in base for _ in range(60)]
    sets += [np.unique(np.concatenate([base[0][:30], rng.integers(0, 10_000, 40)])) for _ in range(60)]
    held = jaccard_join.Sets([s.astype(np.uint64) for s in sets], 90, 100)
    region = jaccard_join.Region(held, np.arange(len(sets)))
    cut = len(sets) - 50
    region.join(np.arange(cut), np.arange(cut, len(sets)))  # the last are guests
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}

    def root(up, i):
        while up[i] != i:
            i = up[i]
        return i

    def parts(pairs):
        up = list(range(len(sets)))
        for a, b in pairs:
            up[root(up, a)] = root(up, b)
        return [root(up, i) for i in range(len(sets))]

    same = lambda p: {(i, j) for i in range(len(sets)) for j in range(i) if p[i] == p[j]}
    assert all(p in links or p[::-1] in links for p in region.links)
    wanted = {(i, j) for i, j in links if not (i >= cut and j >= cut)}
    assert same(parts(region.links)) == same(parts(wanted))


def test_few_rows_in_a_hot_region_reach_one_task(spark):
    """A hot family of near copies that do not all link is cut, and nothing is lost."""
    w = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*w[: i % 7], f"x{i}", *w[i % 7 + 1 : 90], *(f"y{i % 5}-{j}" for j in range(i % 5))])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(frame, rows=6)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 90, 100)
    assert got.where(F.col("component_id") == 0).count() > 6
