import random

import pytest

from conegrid.functions import terms as T
from conegrid.operators import canonical, combined, traversal, valued

PAIR = "parent string, child string"
HEADS = [("*", "linear-dimension"), ("*", "prefix-dimension"), ("*", "dominance-dimension"), ("linear-dimension", "w"), ("prefix-dimension", "g"), ("dominance-dimension", "s")]
KIND = {"w": "linear", "g": "prefix", "s": "dominance"}


def value(name):
    split = T.split_term(name)
    return (split[0], T.read(split[1], KIND[split[0]])) if split and split[0] in KIND else None


def holds(a, b):
    x, y = value(a), value(b)
    if not x or not y or a == b or x[0] != y[0]:
        return False
    met = T.meet(x[1], y[1])
    return met is not None and T.write(met) == T.write(y[1])


def brute_reduction(edges):
    names = {n for e in edges for n in e}
    hops = {(a, b) for a in names for b in names if holds(a, b)}
    down = {}
    for p, c in edges | hops:
        down.setdefault(p, set()).add(c)

    def below(x, skip):
        seen, todo = set(), [m for m in down.get(x, ()) if m != skip]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += down.get(n, ())
        return seen

    anchor = lambda p, c: value(c) is not None and value(c)[0] == p
    return {(p, c) for p, c in edges if anchor(p, c) or c not in below(p, c)}


def graph(seed):
    rng = random.Random(seed)
    terms = [f"w({a})" for a in ("1kg", "2kg", "3kg", "5/2kg")] + ["w(..2kg)", "w(1kg..3kg)", "w(..4kg)", "w(2kg..)", "g(u)", "g(u4)", "g(u4p)", "g(v)", "s(3x2x1m)", "s(4x3x2m)", "s(1x1x1m)"]
    terms = [T.canonical(t, KIND[t[0]]) for t in terms]
    edges = {*HEADS, *((t[0], t) for t in terms)}
    plain = [f"c{i}" for i in range(8)]
    edges |= {("*", c) for c in plain[:3]} | {(rng.choice(plain[:i]), plain[i]) for i in range(3, 8)}
    edges |= {(rng.choice(plain), rng.choice(terms)) for _ in range(6)}
    items = [f"i{i}" for i in range(12)]
    for i in items:
        edges |= {(rng.choice(plain + terms), i) for _ in range(3)}
    return edges


@pytest.mark.parametrize("seed", range(1))
def test_reduction_follows_the_combined_order(spark, seed):
    edges = graph(seed)
    frame = spark.createDataFrame(sorted(edges), PAIR)
    got = {tuple(r) for r in combined.reduce_edges(frame, valued.values(frame)).collect()}
    assert got == brute_reduction(edges)


def test_nearest_containers_give_the_same_order(spark):
    frame = spark.createDataFrame(sorted(graph(7)), PAIR)
    vals = valued.values(frame)
    names = [r[0] for r in vals.select("name").collect()]
    near = combined.nearest_containers(vals)
    reached = {tuple(r) for r in traversal.closure(near).collect()}
    assert reached == {(a, b) for a in names for b in names if holds(a, b)}
    one = {r["parent"] for r in near.where("child = 'w(2kg)'").collect()}
    assert one == {"w(..2kg)", "w(1kg..3kg)", "w(2kg..)"}  # not w(..4kg), which holds w(..2kg)


def test_contraction_reaches_containers(spark):
    edges = {*HEADS, ("w", "w(3kg)"), ("w", "w(..5kg)"), ("*", "light"), ("light", "w(..5kg)"), ("w(3kg)", "parcel"), ("*", "mail"), ("mail", "w(3kg)")}
    frame = spark.createDataFrame(sorted(edges), PAIR)
    got = combined.remove(frame, valued.values(frame), spark.createDataFrame([("w(3kg)",)], "name string"))
    kept = {e for e in edges if "w(3kg)" not in e}
    assert {tuple(r) for r in got.collect()} == kept | {("w(..5kg)", "parcel"), ("mail", "parcel")}


def test_put_spells_checks_and_reduces(spark):
    frame = spark.createDataFrame([*HEADS, ("w", "w(..5kg)"), ("*", "light"), ("light", "w(..5kg)"), ("light", "parcel")], PAIR)
    put = lambda *claims: combined.put(frame, spark.createDataFrame(list(claims), PAIR))
    got = {tuple(r) for r in put(("w(3000g)", "parcel"), ("fragile", "parcel")).collect()}
    assert ("w(3kg)", "parcel") in got and ("w", "w(3kg)") in got and ("*", "fragile") in got and ("light", "parcel") not in got
    with pytest.raises(ValueError, match="computed"):
        put(("w(..5kg)", "w(2kg)"))
    with pytest.raises(ValueError, match="disjoint"):
        put(("w(1kg)", "parcel"), ("w(9kg)", "parcel"))
    with pytest.raises(ValueError, match="cycle"):
        put(("w(3kg)", "heavy"), ("heavy", "w(..9kg)"))  # w(..9kg) holds w(3kg)
    with pytest.raises(ValueError, match="cycle"):
        put(("parcel", "light"))


def test_cycles_apart_from_the_root_are_found(spark):
    frame = spark.createDataFrame([("*", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "leaf"), ("u", "x")], PAIR)
    with pytest.raises(ValueError, match="cycle through x, y, z"):
        canonical.reduce_edges(frame)
    assert canonical.reduce_edges(frame.where("child <> 'x'")).count() == 4


def test_reads_follow_the_combined_order(spark):
    edges = [*HEADS, ("w", "w(3kg)"), ("w", "w(..5kg)"), ("w", "w(9kg)"), ("*", "light"), ("light", "w(..5kg)"), ("w(3kg)", "parcel"), ("w(9kg)", "crate"), ("*", "mail"), ("mail", "parcel"), ("mail", "crate")]
    frame = spark.createDataFrame(edges, PAIR)
    vals = valued.values(frame)
    seen = lambda df: {tuple(r) for r in df.collect()}
    assert seen(combined.get_any(frame, vals, [["w(8kg..)", "mail"], ["light"]])) == {("crate",), ("w(..5kg)",), ("w(3kg)",), ("parcel",)}
    assert combined.get_any(frame, vals, []).count() == 0
    assert seen(combined.refinements(frame, vals, ["mail"], "w")) == {("w(..5kg)", 1), ("w(9kg)", 1)}
    assert seen(combined.refinements(frame, vals, ["mail"], "w(..5kg)")) == {("w(3kg)", 1)}
    scope = spark.createDataFrame([("light",), ("parcel",), ("crate",)], "name string")
    assert seen(combined.entailed(frame, vals, scope)) == {("light", "parcel")}
    part = seen(combined.excerpt(frame, vals, scope.where("name = 'parcel'"), context=True))
    assert part == {e for e in edges if e[1] in ("linear-dimension", "w", "w(3kg)", "w(..5kg)", "light", "mail", "parcel")}
