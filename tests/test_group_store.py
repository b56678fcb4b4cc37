import json
import random

import pytest
from pyspark.sql import functions as F

from conegrid.operators.group_store import GroupStore
from conegrid.streaming.fold import fold_stream

PAIR = "parent string, child string"


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), PAIR)


def group_folders(path):
    return {f"{p.parent.name}/{p.name}" for p in (path / "groups").glob("leaf=*/hash=*")}


def pairs(df):
    return {tuple(r) for r in df.select("parent", "child").collect()}


def test_commits_write_only_groups_that_differ(spark, tmp_path):
    edges = {("*", f"t{i}") for i in range(5)} | {(f"t{i % 5}", f"x{i}") for i in range(300)}
    store = GroupStore(spark, str(tmp_path), digits=2)
    first = store.commit(frame(spark, edges))
    before = group_folders(tmp_path)
    assert len(before) > 100 and pairs(store.load(first)) == edges
    # one record changes, one comes: two groups at most are written
    second = store.commit_batch(frame(spark, [("t0", "x7"), ("t1", "new")]))
    assert 1 <= len(group_folders(tmp_path) - before) <= 2
    assert pairs(store.load(second)) == edges | {("t0", "x7"), ("t1", "new")} and pairs(store.load(first)) == edges
    assert {tuple(r) for r in store.diff(first, second).collect()} == {("x7", "changed"), ("new", "added")}
    # a whole commit of the same graph has the same root and writes nothing; going back writes nothing either
    after = group_folders(tmp_path)
    assert store.commit(frame(spark, edges | {("t0", "x7"), ("t1", "new")})) == second
    assert store.commit_batch(frame(spark, [("t0", "x0")]), frame(spark, [("t0", "x7"), ("t1", "new")])) == first
    assert group_folders(tmp_path) == after and store.head() == first
    # a difference reads the differing groups only
    mine, theirs = store.differing(first, second)
    assert mine.count() <= 2 and theirs.count() <= 2
    assert len(store.records(theirs).inputFiles()) <= 2 < len(store.records(store.leaves(second)).inputFiles())
    with pytest.raises(ValueError):
        store.load("nothing")


def test_empty_graphs_and_names_that_go(spark, tmp_path):
    store = GroupStore(spark, str(tmp_path), digits=1)
    assert store.head() is None
    root = store.commit_batch(frame(spark, [("*", "a")]))
    gone = store.commit_batch(frame(spark, []) if False else spark.createDataFrame([], PAIR), frame(spark, [("*", "a")]))
    assert pairs(store.load(gone)) == set() and {tuple(r) for r in store.diff(root, gone).collect()} == {("a", "removed")}


def test_folds_in_any_order_end_in_one_root(spark, tmp_path):
    rng = random.Random(1)
    announced, whole = [], set()
    for k in range(3):
        peer = GroupStore(spark, f"{tmp_path}/peer{k}", digits=1)
        for _ in range(2):
            edges = {(f"n{rng.randrange(5)}", f"m{rng.randrange(20)}") for _ in range(6)}
            announced.append({"peer": peer.path, "root": peer.commit_batch(frame(spark, edges))})
        whole |= pairs(peer.load(announced[-1]["root"]))
    roots = set()
    for run in range(2):
        lines = [*announced, announced[0], {"peer": None, "root": None}]
        rng.shuffle(lines)
        folder = tmp_path / f"in{run}"
        folder.mkdir()
        own = GroupStore(spark, f"{tmp_path}/own{run}", digits=1)
        for part in (lines[:4], lines[4:], lines[2:5]):  # late and repeated batches
            (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(map(json.dumps, part)))
            fold_stream(spark, str(folder), own.path, f"{tmp_path}/at{run}", digits=1).awaitTermination()
        roots.add(own.head())
        assert pairs(own.load(own.head())) == whole
    assert len(roots) == 1
    assert GroupStore(spark, f"{tmp_path}/direct", digits=1).commit(frame(spark, whole)) in roots
    assert spark.read.parquet(f"{tmp_path}/own0/trees").select(F.countDistinct("root")).first()[0] > 1
