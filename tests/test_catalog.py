import pytest
from pyspark.sql import functions as F

from conegrid.functions.values import contains, overlaps, period
from conegrid.operators import canonical, mutation, queries, traversal
from conegrid.sources.text import read_native, read_projection, write_native
from conegrid.streaming.ingest import ingest

GOODS = {"tool": "*", "steel": "*", "kitchen": "*", "garden": "*", "knife": "tool steel kitchen", "spade": "tool garden", "breadknife": "knife", "edger": "spade steel", "shed": "garden"}
ZOO = {"animal": "*", "pet": "*", "machine": "*", "dog": "animal pet", "cat": "animal pet", "wolf": "animal", "aibo": "machine pet", "spaniel": "dog", "drone": "machine"}


def graph(spark, puts):
    return spark.createDataFrame([(p, c) for c, ps in puts.items() for p in ps.split()], "parent string, child string")


def found(df):
    return {r[0] for r in df.collect()}


def test_conjunction_and_cones(spark):
    e = graph(spark, GOODS)
    assert found(queries.get(e, ["tool", "steel"])) == {"knife", "breadknife", "edger"}
    assert found(traversal.descendants(e, "tool").select("name")) == {"knife", "spade", "breadknife", "edger"}
    assert found(queries.get(e, ["kitchen", "garden"])) == set()
    assert found(queries.get(e, ["nothing", "tool"])) == set()
    assert found(queries.get(e, [])) == set(GOODS)
    assert found(traversal.ancestors(e, "edger").select("name")) == {"spade", "steel", "tool", "garden", "*"}


def test_union_with_absorption(spark):
    e = graph(spark, ZOO)
    assert found(queries.get_any(e, [["animal", "pet"], ["machine"]])) == {"dog", "cat", "spaniel", "aibo", "drone"}
    assert found(queries.get_any(e, [])) == set()
    assert queries.absorb([["a", "b"], ["a"]]) == [["a"]]


def test_is_below_is_reflexive_and_closed_on_unknown(spark):
    pairs = spark.createDataFrame([("dog", "pet"), ("dog", "dog"), ("dog", "machine"), ("x", "x"), ("spaniel", "animal")], "sub string, sup string")
    got = {(r["sub"], r["sup"]): r["below"] for r in queries.is_below(graph(spark, ZOO), pairs).collect()}
    assert got == {("dog", "pet"): True, ("dog", "dog"): True, ("dog", "machine"): False, ("x", "x"): False, ("spaniel", "animal"): True}


def test_merge_is_commutative_and_idempotent(spark):
    a, b = graph(spark, GOODS), graph(spark, {"edger": "tool steel", "trowel": "spade"})
    ab, ba = canonical.merge(a, b), canonical.merge(b, a)
    assert {tuple(r) for r in ab.collect()} == {tuple(r) for r in ba.collect()} == {tuple(r) for r in a.collect()} | {("spade", "trowel")}
    assert {tuple(r) for r in canonical.merge(ab, ab).collect()} == {tuple(r) for r in ab.collect()}
    assert canonical.compare(a, ab).collect()[0]["child"] == "trowel"


def test_cycles_are_refused_and_implied_edges_are_no_news(spark):
    left, right = graph(spark, {"a": "*", "b": "a"}), graph(spark, {"a": "b"})
    with pytest.raises(ValueError, match="cycle through a, b"):
        canonical.merge(left, right)
    with pytest.raises(ValueError, match="cycle"):
        traversal.levels(left.union(right))
    path, short = graph(spark, {"a": "*", "b": "a", "c": "b"}), graph(spark, {"a": "*", "c": "a", "d": "c"})
    assert {tuple(r) for r in canonical.compare(path, short).collect()} == {("a", "b", "left"), ("b", "c", "left"), ("c", "d", "right")}
    assert {tuple(r) for r in canonical.cascade(path, short).collect()} == {("added", 1, 3), ("removed", 2, 3)}
    assert {r["name"]: r["n"] for r in canonical.descendant_counts(path).collect()} == {"*": 3, "a": 2, "b": 1, "c": 0}
    assert found(canonical.unrelated(graph(spark, {"pet": "*", "bat": "pet"}), graph(spark, {"tool": "*", "bat": "tool"}))) == {"bat"}
    with pytest.raises(ValueError, match="no such edge"):
        mutation.remove_edges(path, graph(spark, {"c": "a"}))
    assert {tuple(r) for r in mutation.remove_edges(path, graph(spark, {"c": "b"})).collect()} == {("*", "a"), ("a", "b"), ("*", "c")}


def test_implications(spark):
    rows = [("d1", "Flight"), ("d1", "Booked"), ("d2", "Booked"), ("d3", "Flight"), ("d3", "Booked")]
    got = canonical.implications(spark.createDataFrame(rows, "obj string, attr string")).collect()
    assert [tuple(r) for r in got] == [("Flight", "Booked", 2)]


def test_values(spark):
    rows = spark.createDataFrame([(1, 5, 2, 3), (1, None, 2, None), (None, 4, 0, 5)], "a int, b int, c int, d int")
    assert [r[0] for r in rows.select(contains(*map(F.col, "abcd"))).collect()] == [True, True, False]
    assert all(r[0] for r in rows.select(overlaps(*map(F.col, "abcd"))).collect())
    lo, hi = spark.range(1).select(*period(F.lit("2026-02"))).first()
    assert str(lo) == "2026-02-01 00:00:00" and str(hi) == "2026-02-28 23:59:59"


def test_native_round_trip(spark, tmp_path):
    puts = {"a&b": "*", "it's": "a&b", "C++ notes": "a&b it's"}
    e = spark.createDataFrame([(p, c) for c, ps in {"a&b": ["*"], "it's": ["a&b"], "C++ notes": ["a&b", "it's"]}.items() for p in ps], "parent string, child string")
    write_native(e, str(tmp_path / "g"))
    assert {tuple(r) for r in read_native(spark, str(tmp_path / "g")).collect()} == {tuple(r) for r in e.collect()}
    assert len(puts) == 3


def test_projection_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"item": "x", "supercategories": ["p", "q"]}\n{"item": "y"}\n')
    (tmp_path / "in" / "b.json").write_text('{"item": "x", "supercategories": ["p"]}\n')
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("p", "x"), ("q", "x"), ("*", "y")} == {tuple(r) for r in read_projection(spark, str(tmp_path / "in")).collect()}


def test_bad_projection_line_stops(spark, tmp_path):
    (tmp_path / "x.json").write_text("not json\n")
    with pytest.raises(Exception):  # noqa: B017
        read_projection(spark, str(tmp_path / "x.json")).collect()


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
