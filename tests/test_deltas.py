import random

import pytest

from conegrid.operators import canonical, deltas, indexes

PAIR = "parent string, child string"


def reach(edges):
    down = {}
    for p, c in edges:
        down.setdefault(p, set()).add(c)

    def below(x):
        seen, todo = set(), list(down.get(x, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += down.get(n, ())
        return seen

    return {n: below(n) for n in {x for e in edges for x in e}}


def random_graph(rng, n=25):
    edges = {("*", "n0")}
    for i in range(1, n):
        edges |= {(f"n{rng.randrange(i)}", f"n{i}") for _ in range(rng.choice([1, 1, 2, 3]))}
    return edges


@pytest.mark.parametrize("seed", range(2))
def test_counts_after_a_batch_equal_a_recount(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng)
    gone = set(rng.sample(sorted(edges), 5)) - {("*", "n0")}
    come = {(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(25), 2)) for _ in range(5))} | {("n3", "new"), ("new", "n24"), ("*", "fresh")}
    after = (edges - gone) | come
    index = indexes.EdgeIndex(spark.createDataFrame(sorted(edges), PAIR), buckets=8)
    counts = spark.createDataFrame([(n, len(d)) for n, d in reach(edges).items()], "name string, n long")
    both = [spark.createDataFrame(sorted(x), PAIR) for x in (come, gone - come)]
    got = {r["name"]: r["n"] for r in deltas.update_counts(counts, index, *both).collect()}
    assert got == {n: len(d) for n, d in reach(after).items()}


def test_known_traps(spark):
    edges = [("*", "Animal"), ("Animal", "Dog"), ("Animal", "Pet"), ("Dog", "Spaniel"), ("Pet", "Spaniel")]
    index = indexes.EdgeIndex(spark.createDataFrame(edges, PAIR), buckets=4)
    change = lambda add, rem: {r["name"]: r["delta"] for r in deltas.count_changes(index, spark.createDataFrame(add, PAIR), spark.createDataFrame(rem, PAIR)).collect()}
    assert change([("Dog", "Beagle"), ("Pet", "Beagle")], []) == {"Dog": 1, "Pet": 1, "Animal": 1, "*": 1}  # a diamond counts once
    assert change([("Animal", "Spaniel")], []) == {} and change([], [("Dog", "Spaniel")]) == {"Dog": -1}
    assert change([("Animal", "Dog"), ("nobody", "*")], [("x", "y")]) == {"nobody": 6 - 1}
    assert change([("Dog", "Spaniel")], [("Dog", "Spaniel")]) == {}


def test_rows_read_follow_the_batch(spark):
    edges = [("*", f"t{i}") for i in range(20)] + [(f"t{i}", f"m{i}-{j}") for i in range(20) for j in range(10)] + [(f"m{i}-{j}", f"x{i}-{j}-{k}") for i in range(20) for j in range(10) for k in range(5)]
    index = indexes.EdgeIndex(spark.createDataFrame(edges, PAIR), buckets=128)
    got = deltas.count_changes(index, spark.createDataFrame([("m3-4", "leaf")], PAIR), spark.createDataFrame([("t5", "m5-5")], PAIR)).collect()
    assert {r["name"]: r["delta"] for r in got} == {"m3-4": 1, "t3": 1, "*": 1 - 6, "t5": -6}
    assert index.rows_read("down") + index.rows_read("up") < len(edges) // 2


def test_cone_index_and_staleness(spark, tmp_path):
    rng = random.Random(3)
    edges = sorted(random_graph(rng, 60))
    frame = spark.createDataFrame(edges, PAIR)
    root = indexes.publish_cones(frame, f"{tmp_path}/i", threshold=5, buckets=4)
    truth = reach(edges)
    index = indexes.ConeIndex(spark, f"{tmp_path}/i", root)
    assert index.live and index.threshold == 5
    broad = sorted(n for n, d in truth.items() if len(d) >= 5 and n != "*")
    assert {(r["term"], r["name"]) for r in index.rows(broad).collect()} == {(n, d) for n in broad for d in truth[n]}
    terms = [broad[0], "n59", "nobody", "n1"]
    pairs = lambda df: {(r["term"], r["name"]) for r in df.collect()}
    want = {(t, d) for t in terms for d in truth.get(t, ())}
    assert pairs(index.cones(frame, terms)) == want
    assert len(index.rows([broad[0]]).inputFiles()) <= len(spark.read.parquet(f"{tmp_path}/i/cones").inputFiles())
    # the graph goes on: the index is for another root, is not read, and answers come from the walk
    moved = frame.union(spark.createDataFrame([(broad[0], "later")], PAIR))
    stale = indexes.ConeIndex(spark, f"{tmp_path}/i", "another root")
    assert not stale.live and pairs(stale.cones(moved, [broad[0]])) == {(broad[0], d) for d in truth[broad[0]] | {"later"}}
    assert not indexes.ConeIndex(spark, f"{tmp_path}/nowhere", root).live
    again = indexes.publish_cones(frame.orderBy("child", "parent"), f"{tmp_path}/j", threshold=5, buckets=4)
    assert again == root and pairs(indexes.ConeIndex(spark, f"{tmp_path}/j", root).rows(broad)) == pairs(index.rows(broad))


def test_walk_or_probe(spark):
    edges = [("*", "wide"), ("*", "narrow"), ("*", "mid")] + [("wide", f"x{i}") for i in range(200)] + [("narrow", f"x{i}") for i in range(3)] + [("narrow", "y"), ("mid", "x1"), ("mid", "x7")]
    frame = spark.createDataFrame(edges, PAIR)
    counts = canonical.descendant_counts(frame)
    assert indexes.plan(counts, ["wide", "narrow"]) == (["narrow", "wide"], "probe")
    assert indexes.plan(counts, ["mid", "narrow"]) == (["mid", "narrow"], "walk")
    probe, walk = indexes.EdgeIndex(frame, 64), indexes.EdgeIndex(frame, 64)
    got = indexes.planned_conjunction(probe, counts, ["wide", "narrow"]).collect()
    other = indexes.planned_conjunction(walk, counts, ["wide", "narrow"], depth=1000).collect()
    assert {r[0] for r in got} == {r[0] for r in other} == {"x0", "x1", "x2"}
    assert probe.rows_read("down") < walk.rows_read("down")
    assert indexes.planned_conjunction(probe, counts, ["wide", "nobody"]).count() == 0


def brute_supers(edges, supers):
    up = {n: {a for a, d in reach(edges).items() if n in d} - {"*"} for n in {x for e in edges for x in e}}
    have = set(supers).union(*(up[s] for s in supers)) - {"*"}
    while True:
        more = {n for n in up if n not in have and n != "*" and up[n] and up[n] <= have and up[n] & have}
        if not more:
            break
        have |= more
    parents = {p for p, _ in edges}
    return {n for n in have if n not in parents} or {"*"}


@pytest.mark.parametrize("seed", range(1))
def test_optimised_supers(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 18)
    batch = {f"i{k}": rng.sample([f"n{i}" for i in range(18)], 2) for k in range(4)}
    got = indexes.optimised_supers(spark.createDataFrame(sorted(edges), PAIR), spark.createDataFrame([(i, p) for i, ps in batch.items() for p in ps], "item string, parent string"))
    have = {}
    for r in got.collect():
        have.setdefault(r["item"], set()).add(r["parent"])
    assert have == {i: brute_supers(edges, ps) for i, ps in batch.items()}


def test_leaves_with_one_parent_are_not_walked(spark, monkeypatch):
    """They are counted at their parent, unless the batch names them: as a child, as a parent, or to be removed."""
    edges = [("*", f"t{i}") for i in range(4)] + [(f"t{(i + j) % 4}", f"m{i}") for i in range(8) for j in range(2)] + [(f"m{i}", f"x{i}-{k}") for i in range(8) for k in range(20)]
    come, gone = [("t0", "new"), ("new", "m1"), ("m3", "m2"), ("x1-0", "y"), ("t2", "x4-1"), ("m5", "x2-2")], [("t1", "m1"), ("m2", "x2-2"), ("m6", "x6-0"), ("t3", "m7")]
    df = spark.createDataFrame(edges, PAIR)
    walked, plain = [], deltas.cones
    monkeypatch.setattr(deltas, "cones", lambda near, starts, *share: (walked.append(plain(near, starts, *share)), walked[-1])[1])
    before, after = reach(set(edges)), reach((set(edges) - set(gone)) | set(come))
    counts = canonical.descendant_counts(df)
    assert {r["name"]: r["n"] for r in counts.collect()} == {n: len(d) for n, d in before.items()}
    got = deltas.update_counts(counts, indexes.EdgeIndex(df, buckets=8), spark.createDataFrame(come, PAIR), spark.createDataFrame(gone, PAIR))
    assert {r["name"]: r["n"] for r in got.collect()} == {n: len(d) for n, d in after.items()}
    seen = {r[0] for rows in walked for c in ("term", "name") for r in rows.select(c).collect()}
    assert {n for n in seen if n.startswith("x")} <= {"x1-0", "x4-1", "x2-2", "x6-0"}
