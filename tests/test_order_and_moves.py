import random

import pytest

from conegrid.functions.units import resolve
from conegrid.operators import adoption, combined, traversal, valued
from conegrid.sources import text
from tests.test_catalog import GOODS, ZOO, graph

PAIR = "parent string, child string"
HEADS = [("*", "linear-dimension"), ("linear-dimension", "load"), ("load", "load(..5kg)"), ("load", "load(3kg)"), ("load", "load(9kg)")]


def pairs(df):
    return {tuple(r) for r in df.select("parent", "child").collect()}


def walked(edges):
    """A depth-first walk, names from last to first, backwards."""
    down = {}
    for p, c in edges:
        down.setdefault(p, set()).add(c)
    seen, out = set(), []

    def visit(n):
        if n not in seen:
            seen.add(n)
            for c in sorted(down.get(n, ()), reverse=True):
                visit(c)
            out.append(n)

    for n in sorted({n for e in edges for n in e}, reverse=True):
        visit(n)
    return out[::-1]


def order(df):
    return [r["name"] for r in traversal.topological_order(df).orderBy("place").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_topological_order_is_that_of_the_walk(spark, seed):
    rng = random.Random(seed)
    names = ["*", *rng.sample(["!", "a", "aa", "ab", "b", "é", "z", "Z", "0", "~", "m1", "m10", "m2", "k", "q"], 14)]
    edges = {(names[rng.randrange(i)], names[i]) for i in range(1, len(names)) for _ in range(1 + i % 3)}
    e = spark.createDataFrame(sorted(edges), PAIR)
    assert order(e) == walked(edges)
    assert [r["place"] for r in traversal.topological_order(e.union(e)).orderBy("place").collect()] == list(range(len(names)))


def test_topological_order_edges(spark):
    assert order(spark.createDataFrame([], PAIR)) == []
    loose = [("b", "c"), ("a", "c"), ("*", "x")]  # several tops
    assert order(spark.createDataFrame(loose, PAIR)) == walked(set(loose))
    with pytest.raises(ValueError, match="cycle"):
        order(spark.createDataFrame([("*", "a"), ("a", "b"), ("b", "a")], PAIR))


def test_ancestors_around_a_barrier(spark):
    e = graph(spark, GOODS)
    frame = lambda column, *x: spark.createDataFrame([(n,) for n in x], f"{column} string")
    got = lambda barrier, *starts: {tuple(r) for r in traversal.ancestors_around(e, frame("term", *starts), frame("name", *barrier)).collect()}
    assert got(["spade"], "edger") == {("edger", "steel"), ("edger", "*")}
    assert got(["knife"], "knife") == {("knife", n) for n in ("tool", "steel", "kitchen", "*")}  # a barrier may be the start
    assert got([], "shed") == {("shed", "garden"), ("shed", "*")} and got(["*"], "shed") == {("shed", "garden")}
    with pytest.raises(ValueError, match="no such name: nobody"):
        got([], "shed", "nobody")


def test_moves_are_checked_before_they_happen(spark):
    e = graph(spark, ZOO).union(spark.createDataFrame([*HEADS, ("load(3kg)", "cat"), ("*", "bag"), ("load(..5kg)", "bag")], PAIR))
    moved = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    done, gone = combined.move(e, moved("dog", "wolf"), ["machine"], ["animal"])
    assert pairs(gone) == {("animal", "dog"), ("animal", "wolf")}
    assert {p for p, c in pairs(done) if c == "dog"} == {"pet", "machine"} and {p for p, c in pairs(done) if c == "wolf"} == {"machine"} and ("dog", "spaniel") in pairs(done)
    done, gone = combined.move(e, moved("cat"), ["load(4000g)"])  # a new value, spelled and anchored
    assert {p for p, c in pairs(done) if c == "cat"} == {"load(4kg)"} and ("load", "load(4kg)") in pairs(done)
    assert pairs(gone) == {("animal", "cat"), ("pet", "cat"), ("load(3kg)", "cat")}
    done, gone = combined.move(e, moved("bag"), ["load(3kg)"], ["load(..5kg)"])  # the new parent implies the old one
    assert {p for p, c in pairs(done) if c == "bag"} == {"load(3kg)"} and pairs(gone) == set()
    done, gone = combined.move(e, moved("wolf"), [], ["animal"])
    assert ("*", "wolf") in pairs(done) and pairs(gone) == {("animal", "wolf")}
    for why, args in {
        "the root": (["*"], ["pet"], None), "no such name": (["nobody"], ["pet"], None), "no such category: nowhere": (["dog"], ["nowhere"], None),
        "no such category: gone": (["dog"], ["pet"], ["gone"]), "not right under": (["spaniel"], ["machine"], ["animal"]), "not under it": (["wolf"], ["machine"], ["pet"]),
        "under itself": (["animal"], ["spaniel"], None), "under itself: dog": (["dog"], ["dog"], None), "disjoint": (["cat"], ["load(9kg)"], ["pet"]),
    }.items():
        with pytest.raises(ValueError, match=why):
            combined.move(e, moved(*args[0]), *args[1:])


def test_preview_tells_what_a_merge_brings(spark):
    ours = graph(spark, {"planet": "*", "mercury": "planet", "probe": "mercury", "leaf": "planet", "unit-declaration": "*", "unit(foo=2kg)": "unit-declaration"})
    theirs = graph(spark, {"metal": "*", "mercury": "metal", "leaf": "metal", "probe": "*", "unit-declaration": "*", "unit(foo=3kg)": "unit-declaration", "unit(bar=1baz)": "unit-declaration"})
    got = {tuple(r) for r in adoption.preview(ours, theirs).collect()}
    items = {("item", "metal", "*"), ("item", "unit(foo=3kg)", "unit-declaration"), ("item", "unit(bar=1baz)", "unit-declaration")}
    claims = {("claim", "mercury", "metal"), ("claim", "leaf", "metal")}
    assert got == items | claims | {("unrelated", "mercury", "metal"), ("conflict", "foo", "unit foo is defined twice"), ("conflict", "bar", "unit bar=1baz is never resolved")}
    assert adoption.preview(ours, ours).isEmpty() and adoption.preview(ours, spark.createDataFrame([], PAIR)).isEmpty()
    assert resolve(["unit(kg=2lb)"])[1] == {"kg": "unit kg is defined twice"} and resolve(["unit(kg=1000g)"])[1] == {}


def test_preview_counts_containment(spark):
    """A category under a value here and under a wider one there is not unrelated."""
    ours = spark.createDataFrame([*HEADS, ("load(3kg)", "box"), ("box", "lid")], PAIR)
    theirs = spark.createDataFrame([*HEADS[:3], ("load(..5kg)", "box")], PAIR)
    assert {r["name"] for r in adoption.preview(ours, theirs).where("part = 'unrelated'").collect()} == set()
    assert valued.values(ours).count() == 3


def test_manchester_texts(spark, tmp_path):
    (tmp_path / "a.omn").write_text(
        "Prefix: : <http://x#>\nOntology: <http://x>\n\nClass: :dog\n    SubClassOf: :pet, owl:Thing\n\nClass: :pet\n    SubClassOf: owl:Thing\n\nClass: <wolf>\n    Annotations: x :y\n    SubClassOf: <beast>,\n        :wild\n    SubClassOf: :grey\n\nClass: :grey\n"
    )
    path = str(tmp_path / "a.omn")
    assert pairs(text.read_manchester(spark, path)) == {("pet", "dog"), ("*", "pet"), ("grey", "wolf"), ("*", "grey")}
    beasts = graph(spark, {"beast": "*", "bear": "beast", "pet": "beast"})
    assert pairs(text.read_manchester(spark, path, beasts)) == {("pet", "dog"), ("*", "pet"), ("grey", "wolf"), ("beast", "wolf"), ("*", "grey")}
    assert pairs(text.merge_manchester(beasts, path)) == pairs(beasts) | {("pet", "dog"), ("grey", "wolf"), ("beast", "wolf"), ("*", "grey")}
    e = graph(spark, GOODS)
    text.write_manchester(e, str(tmp_path / "g.omn"))
    text.write_owl(e, str(tmp_path / "g.owl"))
    assert pairs(text.read_graph(spark, str(tmp_path / "g.omn"))) == pairs(e) == pairs(text.read_graph(spark, str(tmp_path / "g.owl")))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "g.owl").glob("part-*")))
    import xml.etree.ElementTree as E

    about = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}about"
    assert [c.get(about)[1:] for c in E.fromstring(whole)] == [n for n in walked(pairs(e)) if n != "*"]
    text.write_owl(spark.createDataFrame([], PAIR), str(tmp_path / "none.owl"))
