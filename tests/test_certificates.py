import copy
import random

import pytest

from conegrid.operators import certificates, valued

from test_combined import HEADS, PAIR, graph, holds, value


def brute_below(edges, sub, sup):
    """By all pairs: asserted edges, heads over their terms, and containment."""
    names = {n for e in edges for n in e} | {sub, sup}
    if sub not in {c for _, c in edges} and not value(sub):
        return False
    up = {}
    for p, c in edges | {(a, b) for a in names for b in names if holds(a, b)} | {(value(n)[0], n) for n in names if value(n)}:
        up.setdefault(c, set()).add(p)
    seen, todo = {sub}, [sub]
    while todo:
        for p in up.get(todo.pop(), ()):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return sup in seen or sup == "*"


def test_certificates_of_virtual_terms(spark, monkeypatch):
    monkeypatch.setattr(certificates, "BLOCK", 2)  # stars of several levels
    rng, edges = random.Random(4), graph(4)
    edges |= {("w", f"w({a}kg..{b}kg)") for a, b in ((5, 9), (6, 7), (6, 8))} | {("c0", "w(6kg..8kg)")}
    df = spark.createDataFrame(sorted(edges), PAIR)
    book = certificates.publish(df, valued.values(df))
    assert book.levels > 1 and book.depth > 0
    assert certificates.publish(df.repartition(5), valued.values(df)).root == book.root
    names = sorted({n for e in edges for n in e} - {"*"})
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(5)]
    pairs += [("w(6kg)", "c0"), ("w(13/2kg)", "w(..20kg)"), ("w(13/2kg)", "w(6kg..7kg)"), ("w(30kg)", "c0"), ("g(u4pr)", "g(u4)"), ("s(1x1x1m)", "s(2x2x2m)"), ("nobody", "*"), ("nobody", "nobody"), ("i0", "*"), ("i0", "nobody"), ("w(6kg)", "w")]
    proofs = {}
    for sub, sup in pairs:
        proof = proofs[sub, sup] = certificates.prove(book, sub, sup)
        spelled = [f"{v[0]}({certificates.T.write(v[1])})" if (v := value(n)) else n for n in (sub, sup)]
        assert certificates.verify(proof, book.root) == proof["below"] == brute_below(edges, *spelled), (sub, sup)
    assert {p["below"] for p in proofs.values()} == {True, False}
    # what a false certificate might change: the claim, an entry, a star's block, a path, the root
    sound = proofs["w(6kg)", "c0"]
    assert sound["below"]
    star = next(k for k in sound["bodies"] if k.startswith("s\nw\n0\n"))
    for change in (
        lambda c: c.update(below=False), lambda c: c["bodies"].update({star: "[]"}), lambda c: c["bodies"].pop(star), lambda c: c["nodes"].pop(min(c["nodes"], key=lambda p: -len(p))),
        lambda c: c["nodes"][""].pop(), lambda c: c.update(levels=0), lambda c: c.update(sub="w(30kg)"),
    ):
        false = copy.deepcopy(sound)
        change(false)
        with pytest.raises(ValueError):
            certificates.verify(false, book.root)
    with pytest.raises(ValueError):
        certificates.verify(sound, "0" * 64)


def test_certificates_of_graphs_without_values(spark):
    plain = spark.createDataFrame([*HEADS, ("*", "a"), ("a", "b")], PAIR)
    book = certificates.publish(plain, valued.values(plain))
    assert certificates.verify(certificates.prove(book, "b", "a"), book.root) and not certificates.verify(certificates.prove(book, "a", "b"), book.root)
    assert certificates.verify(certificates.prove(book, "w(3kg)", "w(..4kg)"), book.root)  # heads are known, values need not be
    empty = certificates.publish(plain.limit(0), valued.values(plain.limit(0)))
    assert not certificates.verify(certificates.prove(empty, "a", "a"), empty.root)


def test_two_hops_through_an_asserted_name(spark):
    """A value under a name that hangs under a value of another head: containment counts on both sides of the name."""
    edges = {*HEADS, ("w", "w(..5kg)"), ("light", "w(..5kg)"), ("g", "g(u4)"), ("g", "g(u)"), ("g(u4)", "light"), ("w", "w(3kg)"), ("w(3kg)", "i")}
    df = spark.createDataFrame(sorted(edges), PAIR)
    df = valued.materialise(spark.createDataFrame([*HEADS], PAIR), df)
    vals = valued.values(df)
    pairs = spark.createDataFrame([("i", "light"), ("i", "g(u4)"), ("i", "g(u)"), ("i", "g(v)")], "sub string, sup string")
    assert {(r["sup"], r["below"]) for r in valued.is_below(df, vals, pairs).collect()} == {("light", True), ("g(u4)", True), ("g(u)", True), ("g(v)", False)}


def test_entries_are_shuffled_once(spark):
    """Entries and leaves are made where the dealt edges lie, and a leaf's lines are not stored beside its entries."""
    edges = sorted({("*", "a"), *((f"n{i % 7}", f"m{i}") for i in range(300)), *((f"n{i % 5}", f"m{i}") for i in range(300))})
    df = spark.createDataFrame(edges, PAIR)
    written, plans = [], certificates.materialize

    def watched(rows, *by):
        written.append((rows.columns, rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return plans(rows, *by)

    certificates.materialize = watched
    try:
        book = certificates.publish(df, valued.values(df))
    finally:
        certificates.materialize = plans
    assert [n for columns, n in written if "entries" in columns] == [1] and book.depth == 2
    assert book.nodes.where("length(prefix) >= 2").isEmpty()  # none for the leaves
    assert sorted(e["key"] for r in book.leaves.collect() for e in r["entries"]) == sorted({f"n\n{c}" for _, c in edges})
    assert certificates.verify(certificates.prove(book, "m1", "n1"), book.root) and not certificates.verify(certificates.prove(book, "m1", "n2"), book.root)
