import pytest

from conegrid.operators import canonical, mutation, queries, traversal, versions
from conegrid.sources.text import read_owl_classes
from tests.test_catalog import GOODS, ZOO, found, graph


def pairs(df):
    return {tuple(r) for r in df.select("parent", "child").collect()}


def of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_put_reduces_and_refuses_cycles(spark):
    e = graph(spark, ZOO)
    batch = spark.createDataFrame([("mammal", "dog"), ("animal", "mammal"), ("dog", "dog")], "parent string, child string")
    got = pairs(mutation.put(e, batch))
    assert got == pairs(e) - {("animal", "dog")} | {("mammal", "dog"), ("animal", "mammal")}
    with pytest.raises(ValueError, match="cycle"):
        mutation.put(e, spark.createDataFrame([("spaniel", "animal")], "parent string, child string"))


def test_remove_contracts_in_any_order(spark):
    e = graph(spark, GOODS)
    one = mutation.remove(mutation.remove(e, of(spark, "spade")), of(spark, "knife"))
    both = mutation.remove(e, of(spark, "knife", "spade", "unknown"))
    assert pairs(one) == pairs(both)
    assert {("tool", "edger"), ("garden", "edger"), ("steel", "edger"), ("kitchen", "breadknife"), ("steel", "breadknife")} <= pairs(both)
    assert pairs(mutation.remove(e, of(spark))) == pairs(e)


def test_cone_removal_spares_what_is_reachable(spark):
    e = graph(spark, ZOO)
    assert found(mutation.cone_removal_plan(e, "animal")) == {"animal", "wolf"}
    left = pairs(mutation.remove_cone(e, "animal", "pet"))
    assert left == {("*", "machine"), ("machine", "aibo"), ("machine", "drone")}


def test_move_never_orphans(spark):
    e = graph(spark, ZOO)
    got = pairs(mutation.reclassify(e, of(spark, "wolf"), ["pet"]))
    assert ("pet", "wolf") in got and ("animal", "wolf") not in got
    assert ("*", "wolf") in pairs(mutation.reclassify(e, of(spark, "wolf"), [], ["animal"]))


def test_excerpt_and_codes(spark):
    e = graph(spark, GOODS)
    answer = queries.get(e, ["tool"])
    assert pairs(mutation.excerpt(e, answer)) == {("*", "knife"), ("*", "spade"), ("knife", "breadknife"), ("spade", "edger")}
    assert ("tool", "knife") in pairs(mutation.excerpt(e, answer, context=True))
    assert pairs(canonical.cover_edges(canonical.codes(e))) == pairs(e)
    order = {r["name"]: r["level"] for r in traversal.levels(e).collect()}
    assert all(p == "*" or order[p] < order[c] for p, c in pairs(e))
    assert found(queries.contested(e, "tool", "knife")) == set()
    assert [tuple(r) for r in queries.narrowing(e, queries.get(e, ["tool"]), ["tool"]).collect()] == [("steel", 3), ("garden", 2), ("kitchen", 2), ("knife", 1), ("spade", 1)]


def test_versions(spark, tmp_path):
    e, store = graph(spark, ZOO), str(tmp_path / "store")
    first = versions.commit(e, store, "zoo")
    assert versions.commit(e.repartition(3), store) == first
    second = versions.commit(mutation.remove(e, of(spark, "dog")), store, "no dog")
    assert [r["root"] for r in versions.history(spark, store).orderBy("number").collect()] == [first, second]
    assert pairs(versions.load_at(spark, store, first[:10])) == pairs(e)
    third = versions.commit(mutation.remove(e, of(spark, "dog", "cat")), store, "no cat")
    assert versions.undo(spark, store) == second and versions.undo(spark, store) == first and versions.head(spark, store) == (1, first)
    assert versions.redo(spark, store, 2) == third and versions.undo(spark, store, 2) == first
    with pytest.raises(ValueError, match="undo"):
        versions.undo(spark, store)
    assert {tuple(r) for r in versions.status(mutation.remove(e, of(spark, "drone")), store).collect()} == {("drone", "removed")}
    assert versions.commit(mutation.remove(e, of(spark, "cat")), store, "other line") == versions.head(spark, store)[1]
    assert [(r["message"], r["current"]) for r in versions.history(spark, store, 2).collect()] == [("other line", True), ("zoo", False)]
    with pytest.raises(ValueError, match="redo"):
        versions.redo(spark, store)
    with pytest.raises(ValueError):
        versions.load_at(spark, store, "zz")
    changes = versions.changed(versions.record_hashes(e), versions.record_hashes(versions.load_at(spark, store, second)))
    assert {tuple(r) for r in changes.collect()} == {("dog", "removed"), ("spaniel", "changed")}
    peer = graph(spark, {"fox": "animal"})
    assert pairs(versions.sync(e, peer)) == pairs(e) | {("animal", "fox")}
    acts = spark.createDataFrame([("x", "a", "assert"), ("y", "a", "assert"), ("y", "a", "retract"), ("z", "b", "assert")], "subject string, author string, act string")
    assert {tuple(r) for r in versions.standing(acts, ["a"]).collect()} == {("x", True), ("y", False), ("z", False)}


def test_owl_classes(spark, tmp_path):
    (tmp_path / "g.owl").write_text(
        '<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o"><owl:Class rdf:about="http://x#pet"><rdfs:label>p</rdfs:label></owl:Class>'
        '<owl:Class rdf:about="http://x#dog"><rdfs:subClassOf rdf:resource="http://x#pet"/><rdfs:subClassOf rdf:resource="http://x#animal"/></owl:Class></rdf:RDF>'
    )
    assert pairs(read_owl_classes(spark, str(tmp_path / "g.owl"))) == {("*", "pet"), ("pet", "dog"), ("animal", "dog")}
