"""Work that must not grow with leaves or pairs: rounds walk among names that have something below them, and ranges
travel with their blocks."""

import pytest

from conegrid.operators import canonical, ranges, traversal

INNER = [("*", "a"), ("*", "b"), ("a", "c"), ("b", "c"), ("a", "d")]
LEAVES = [(p, f"leaf{i}") for i in range(40) for p in ("c", "d")] + [("*", "leaf0"), ("x", "leaf1")]


@pytest.fixture
def written(monkeypatch):
    """The numbers of rows of the tables written."""
    sizes, real = [], traversal.materialize

    def counted(df, *by):
        out = real(df, *by)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(traversal, "materialize", counted)
    return sizes


def brute(edges):
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    return pairs


def test_rounds_leave_leaves_out(spark, written):
    e = spark.createDataFrame(INNER + LEAVES, "parent string, child string")
    got = {tuple(r) for r in traversal.closure(e).collect()}
    assert got == brute(INNER + LEAVES)
    assert sorted(written)[-2] <= 10  # only the split itself holds the leaves
    written.clear()
    level = {r["name"]: r["level"] for r in traversal.levels(e).collect()}
    assert level == {"a": 1, "b": 1, "c": 2, "d": 2} | {f"leaf{i}": 3 for i in range(40)}
    assert sorted(written)[-2] <= 10
    assert traversal.levels(e.where("parent = 'c'"), "c").count() == 40  # a root with leaves alone
    assert traversal.levels(e, "nobody").count() == 0


def test_codes_of_leaves_and_their_covers(spark):
    e = spark.createDataFrame(INNER + LEAVES, "parent string, child string")
    codes = {r["name"]: r["code"] for r in canonical.codes(e).collect()}
    above = brute(INNER + LEAVES)
    assert codes == {n: sorted({a for a, d in above if d == n} | {n}) for n in {d for _, d in above}}
    cover = {tuple(r) for r in canonical.cover_edges(canonical.codes(e)).collect()}
    assert cover == {(p, c) for p, c in set(INNER + LEAVES) if not any((p, m) in above and (m, c) in above for m, _ in above)}


def test_pairs_are_not_joined_with_their_ranges_again(spark):
    points = spark.createDataFrame([(1, i % 7, i) for i in range(200)], "g int, at int, id int")
    spans = spark.createDataFrame([(1, i, i + 2, i) for i in range(6)], "g int, lo int, hi int, id int")
    got = ranges.points_in_ranges(points, spans, ["g"], "at", "lo", "hi", block=8)
    assert {(r["r"]["id"], r["p"]["id"]) for r in got.collect()} == {(i, j) for i in range(6) for j in range(200) if i <= j % 7 <= i + 2}
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].split("\n")[0]
    assert "_block" in top  # nothing is joined after points have met ranges
