import pytest
from pyspark.sql import functions as F

from conegrid.operators import browse, contexts, provenance, versions
from conegrid.plans import vocabulary
from conegrid.sources import text

PORT = {"boat": "*", "sail": "*", "owned": "*", "yacht": "boat sail", "ferry": "boat", "tug": "boat owned", "mine": "yacht owned"}


def graph(spark, puts):
    return spark.createDataFrame([(p, c) for c, ps in puts.items() for p in ps.split()], "parent string, child string")


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_query_words_and_pages(spark):
    e = graph(spark, PORT)
    assert browse.disjuncts("boat sail or owned".split()) == [["boat", "sail"], ["owned"]]
    for wrong in ("or a", "a or", "a or or b"):
        with pytest.raises(ValueError):
            browse.disjuncts(wrong.split())
    assert browse.count(e, [["boat", "owned"], ["sail"]]).first()[0] == 3
    assert [tuple(r) for r in browse.page(e.select(F.col("child").alias("name")).distinct(), 2).collect()] == [("boat", 7, True), ("ferry", 7, True)]
    assert rows(browse.reachable(e, spark.createDataFrame([("boat",), ("mine",)], "term string"), spark.createDataFrame([("mine",), ("tug",)], "name string"))) == {("boat", 2), ("mine", 0)}
    assert rows(browse.get_by_graph(e, graph(spark, {"boat": "*", "owned": "*"}))) == {("tug",), ("mine",)}
    assert ("refine", "owned", 1) in rows(browse.position(e, ["sail"]))


def test_concepts_and_stability(spark):
    table = {"a": "x y", "b": "x z", "c": "x y z", "d": "z"}
    context = spark.createDataFrame([(o, t) for o, ts in table.items() for t in ts.split()], "obj string, attr string")
    assert rows(contexts.extent(context, ["x", "y"])) == {("a",), ("c",)} and rows(contexts.closure(context, ["y"])) == {("x",), ("y",)}
    from itertools import chain, combinations

    subsets = lambda s: chain.from_iterable(combinations(s, n) for n in range(len(s) + 1))
    sets = {o: set(t.split()) for o, t in table.items()}
    meet = lambda objs: frozenset(set.intersection(*(sets[o] for o in objs)) if objs else {"x", "y", "z"})
    want = {meet(s) for s in subsets(table)}
    got = contexts.concepts(context)
    assert {(frozenset(r["intent"]), r["support"]) for r in got.collect()} == {(i, sum(i <= s for s in sets.values())) for i in want}
    below = {(a, b) for a in want for b in want if a < b}
    assert {(frozenset(r[0]), frozenset(r[1])) for r in contexts.covers(got).collect()} == {(a, b) for a, b in below if not any((a, c) in below and (c, b) in below for c in want)}
    for attrs in ([], ["x"], ["z"], ["x", "y"]):
        ext = [o for o in sets if set(attrs) <= sets[o]]
        assert contexts.stability(context, attrs) == sum(meet(s) == meet(ext) for s in subsets(ext)) / 2 ** len(ext)
    named = spark.createDataFrame([(["x", "y"],)], "code array<string>")
    assert {frozenset(r[0]) for r in contexts.unnamed(got, named).collect()} == {i for i in want if 0 < len(i) < 3} - {frozenset("xy")}


def test_certificates(spark):
    e = graph(spark, PORT | {"caf\u00e9 \"boat\"": "yacht"})
    root = versions.root_of(versions.record_hashes(e))
    proof = provenance.prove_below(e, "mine", "boat")
    assert [r["name"] for r in proof] == ["mine", "yacht"] and provenance.verify_below(proof, root, "mine", "boat")
    assert provenance.verify_below(provenance.prove_below(e, "caf\u00e9 \"boat\"", "sail"), root, "caf\u00e9 \"boat\"", "sail")
    assert provenance.prove_below(e, "ferry", "sail") is None and provenance.prove_below(e, "nobody", "nobody") is None
    assert provenance.verify_below(provenance.prove_below(e, "tug", "tug"), root, "tug", "tug")
    assert not provenance.verify_below(proof, root, "mine", "ferry") and not provenance.verify_below(proof[1:], root, "mine", "boat") and not provenance.verify_below([], root, "a", "a")
    assert not provenance.verify_below([proof[0] | {"up": ["boat"]}], root, "mine", "boat") and not provenance.verify_below(proof, "0" * 64, "mine", "boat")
    store = provenance.acts(provenance.subjects(spark.createDataFrame([("mine", "boat", "ann", "assert"), ("mine", "boat", "ann", "assert"), ("tug", None, "bob", "retract")], "sub string, sup string, author string, act string")))
    assert store.count() == 2 == provenance.unite(store, store).count()
    assert provenance.about(store, spark.createDataFrame([("mine", "boat")], "sub string, sup string")).count() == 1


def test_texts_round_trip(spark, tmp_path):
    e = graph(spark, PORT)
    meta = spark.createDataFrame([("mine", '{"a": 1}')], "name string, meta string")
    text.write_native(e, str(tmp_path / "g.od"), meta)
    assert rows(text.read_graph(spark, str(tmp_path / "g.od"))) == rows(e) and rows(text.read_native_meta(spark, str(tmp_path / "g.od"))) == rows(meta)
    text.write_owl(e, str(tmp_path / "g.owl"))
    assert rows(text.read_graph(spark, str(tmp_path / "g.owl"))) == rows(e)
    text.manchester_frames(e).orderBy("name").select("frame").coalesce(1).write.text(str(tmp_path / "g.omn"))
    assert rows(text.read_graph(spark, str(tmp_path / "g.omn"))) == rows(e)
    (tmp_path / "bad.od").write_text("a b\n'open\n")
    with pytest.raises(Exception, match="line 2"):
        text.read_native(spark, str(tmp_path / "bad.od")).collect()
    (tmp_path / "twice.od").write_text("b a\nc b a\na\n")
    assert rows(text.read_native(spark, str(tmp_path / "twice.od"), reduced=True)) == {("*", "a"), ("a", "b"), ("b", "c")}
    maps = lambda *x: spark.createDataFrame(list(x), "name string, meta map<string,string>")
    merged = {r["name"]: r["meta"] for r in text.merge_meta(maps(("a", {"k": "1"})), maps(("a", {"k": "2", "l": "3"}), ("b", {}))).collect()}
    assert merged == {"a": {"k": "1", "l": "3"}, "b": {}}


def test_vocabularies_and_overlays(spark):
    e = graph(spark, PORT)
    once = vocabulary.adopt(e, vocabulary.pack(spark, "coins"))
    assert rows(vocabulary.adopt(once, vocabulary.pack(spark, "coins"))) == rows(once) and vocabulary.packs_with("sat") == ["coins"]
    with pytest.raises(ValueError):
        vocabulary.pack(spark, "nothing")
    machine = graph(spark, {"on:disk": "*", "mine": "on:disk", "log": "on:disk"})
    assert rows(vocabulary.overlay(e, machine).where("child = 'mine'")) == {("yacht", "mine"), ("owned", "mine"), ("on:disk", "mine")}
    again = vocabulary.rebuild(vocabulary.overlay(e, machine), "on:disk", graph(spark, {"on:disk": "*", "tug": "on:disk"}))
    assert rows(again.where("parent = 'on:disk'")) == {("on:disk", "tug")} and ("yacht", "mine") in rows(again) and rows(again.where("child = 'log'")) == set()
