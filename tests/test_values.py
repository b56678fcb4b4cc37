import pytest

from conegrid.functions import terms as T
from conegrid.functions.units import UNITS, declared
from conegrid.operators import valued

SPELLED = [
    ("weight(0.5g)", "linear", "weight(1/2000kg)"), ("weight(1lb)", "linear", "weight(45359237/100000000kg)"), ("n(0..5)", "linear", "n(..5)"), ("n(..0)", "linear", "n(0)"), ("n(0..)", "linear", "n(0..)"),
    ("box(19x23x39cm)", "dominance", "box(39/100x23/100x19/100m)"), ("c(2dz)", "count", "c(24)"), ("c(1..5)", "count", "c(..5)"), ("c(1..)", "count", "c(1..)"), ("t(2024-02)", "calendar", "t(2024-02-01T00:00:00Z..2024-02-29T23:59:59Z)"),
    ("t(..2026)", "calendar", "t(..2026-12-31T23:59:59Z)"), ("t(2026-08-15)", "linear", "t(2026-08-15T00:00:00Z..2026-08-15T23:59:59Z)"), ("w(2kg..2000g)", "linear", "w(2kg)"), ("h(-40C)", "linear", "h(4663/20K)"), ("h(-40F)", "linear", "h(4663/20K)"),
]
REFUSED = [
    ("w(3zz)", "linear"), ("w(5kg..1kg)", "linear"), ("w(1kg..2s)", "linear"), ("w(-3kg)", "linear"), ("c(0)", "count"), ("c(1/2)", "count"), ("c(3kg)", "count"), ("t(2026-13)", "calendar"), ("t(2026-8)", "calendar"), ("t(2026-02-30)", "calendar"),
    ("t(..)", "calendar"), ("n(1/0)", "linear"), ("h(-300C)", "linear"), ("b(5cm)", "dominance"), ("b(1kgx2m)", "dominance"), ("g(a..b)", "prefix"), ("plain", "linear"), ("two(a)(b)", "prefix"),
]


@pytest.mark.parametrize("raw, kind, want", SPELLED)
def test_one_spelling(raw, kind, want):
    assert T.canonical(raw, kind) == want == T.canonical(want, kind)
    assert T.canonical(T.render(want, kind), kind) == want


@pytest.mark.parametrize("raw, kind", REFUSED)
def test_refused(raw, kind):
    with pytest.raises(ValueError):
        T.canonical(raw, kind)


def test_declared_units():
    units = declared(["unit-family(SOL)", "unit(five=5tiny)", "unit(tiny=1SOL/1000000000)"])
    assert T.canonical("fee(200000000five)", "linear", units) == "fee(1SOL)"
    for wrong in (["unit(a=1b)"], ["unit(kg=2lb)"]):
        with pytest.raises(ValueError):
            declared(wrong)
    assert len(UNITS) > 200 and T.render("w(3000kg)", "linear") == "w(3t)"


@pytest.fixture(scope="module")
def shop(spark):
    rows = [("*", "dimension"), ("dimension", "linear-dimension"), ("dimension", "dominance-dimension"), ("dimension", "prefix-dimension"), ("linear-dimension", "load"), ("dominance-dimension", "room"), ("prefix-dimension", "zone"), ("*", "light"), ("*", "fresh")]
    claims = [("load(3kg)", "crate"), ("load(1200g)", "sack"), ("load(9kg)", "barrel"), ("light", "load(..5kg)"), ("fresh", "sack"), ("room(30x20cm)", "shelf"), ("room(1mx50cm)", "hall"), ("zone(ab)", "north"), ("zone(abc)", "port")]
    frame = lambda x: spark.createDataFrame(x, "parent string, child string")
    e = valued.materialise(frame(rows), frame(claims))
    return e, valued.values(e)


def test_combined_order(spark, shop):
    e, v = shop
    got = lambda *t: {r[0] for r in valued.get(e, v, list(t)).collect()}
    assert got("load(..5000g)") == {"load(3kg)", "load(6/5kg)", "crate", "sack"}
    assert got("load(..5kg)", "load(2kg..)") == {"load(3kg)", "crate"}
    assert got("load(..2kg)", "load(3kg..)") == set()
    assert got("light") == {"load(..5kg)", "load(3kg)", "load(6/5kg)", "crate", "sack"}
    assert got("light", "fresh") == got("fresh", "load(..5kg)") == {"sack"}
    assert got("room(40x20cm)") == {"room(3/10x1/5m)", "shelf"} and got("zone(a)") == {"zone(ab)", "zone(abc)", "north", "port"}
    assert {r[0] for r in valued.overlapping(e, v, "load(4kg..6kg)").collect()} == {"load(..5kg)"}
    with pytest.raises(ValueError):
        valued.overlapping(e, v, "light")
    pairs = [("crate", "light"), ("crate", "load(1kg..)"), ("barrel", "light"), ("load(4kg)", "light"), ("load(4000g)", "load(..5kg)"), ("port", "zone(ab)"), ("x", "x"), ("sack", "*"), ("crate", "crate"), ("crate", "load(zz)")]
    below = {(r["sub"], r["sup"]): r["below"] for r in valued.is_below(e, v, spark.createDataFrame(pairs, "sub string, sup string")).collect()}
    assert below == dict.fromkeys(pairs, True) | dict.fromkeys([("barrel", "light"), ("x", "x"), ("crate", "load(zz)")], False)


def test_value_guards(spark, shop):
    e, v = shop
    frame = lambda *x: spark.createDataFrame(list(x), "parent string, child string")
    with pytest.raises(ValueError, match="load"):
        valued.materialise(e, frame(("load(3m)", "rope")))
    with pytest.raises(Exception, match="unknown unit"):
        valued.materialise(e, frame(("load(3zz)", "rope"))).collect()
    two = e.union(frame(("load(..5kg)", "odd"), ("load(9kg)", "odd"), ("load(3kg)", "even"), ("load(..5kg)", "even")))
    assert [tuple(r) for r in valued.disjoint_parents(two, v).collect()] == [("odd", "load")]
    assert {r["head"]: r["spaces"] for r in valued.spaces(v).collect()} == {"load": "linear:mass", "room": "dominance:length:2", "zone": "prefix"}
