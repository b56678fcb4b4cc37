import random

from conegrid.functions import terms as T
from conegrid.operators import valued

PAIR = "parent string, child string"
HEADS = [("*", "linear-dimension"), ("linear-dimension", "w"), ("linear-dimension", "u"), ("*", "light")]


def test_only_typed_names_are_read(spark, monkeypatch):
    """Spelling costs a parse, so untyped names never come to it."""
    seen, real = [], valued.canonical_names
    monkeypatch.setattr(valued, "canonical_names", lambda terms, *rest: seen.extend(r["name"] for r in terms.collect()) or real(terms, *rest))
    claims = [("w(2.50)", "a"), ("box", "a"), ("w(2.5)", "b"), ("odd(1)", "c"), (None, "d")]
    e, v = valued.materialised(spark.createDataFrame(HEADS, PAIR), spark.createDataFrame(claims, PAIR))
    assert sorted(seen) == ["odd(1)", "w(2.5)", "w(2.50)"]
    found = set(map(tuple, e.collect()))
    assert found == {*HEADS, ("w(5/2)", "a"), ("w(5/2)", "b"), ("box", "a"), ("odd(1)", "c"), ("w", "w(5/2)")}
    assert [r["name"] for r in v.collect()] == ["w(5/2)"]


def test_few_names_asked_about_are_walked_down_from(spark, monkeypatch):
    """Both directions give the order, also over values of two heads in turn; few sups are walked from, not many subs."""
    rng = random.Random(1)
    name = lambda h: f"{h}({rng.randint(1, 6)})" if rng.random() < 0.5 else f"{h}({rng.randint(1, 3)}..{rng.randint(4, 6)})"
    claims = [(name("w"), f"i{i}") for i in range(12)] + [("light", "w(1..3)")] + [(name("w"), name("u")) for _ in range(3)] + [(name("u"), f"i{i}") for i in range(4)]
    e, v = valued.materialised(spark.createDataFrame(HEADS, PAIR), spark.createDataFrame(claims, PAIR))
    edges = set(map(tuple, e.collect())) | {("w", "w(2..5)"), ("u", "u(2..6)"), ("w", "w(1..5)")}
    names = sorted({x for p in edges for x in p})
    value = {n: (n[0], T.read(n[2:-1], "linear")) for n in names if "(" in n}
    above = edges | {(a, b) for a, (h, x) in value.items() for b, (k, y) in value.items() if a != b and h == k and x.lo <= y.lo and y.hi <= x.hi}
    order = above
    while (more := order | {(a, d) for a, b in order for c, d in above if b == c}) != order:
        order = more
    starts, real = [], valued._reached

    def noted(whole, every, begin, down):
        starts.append((begin.count(), down))
        return real(whole, every, begin, down)

    monkeypatch.setattr(valued, "_reached", noted)
    sups = ["light", "w(1..5)", "w(2..5)", "nobody", "*", "u(2..6)"]
    ask = lambda pairs: {(r["sub"], r["sup"]): r["below"] for r in valued.is_below(e, v, spark.createDataFrame(pairs, "sub string, sup string")).collect()}
    true = lambda a, b: "nobody" not in (a, b) and a != "*" and (a == b or b == "*" or (b, a) in order)
    for subs in ([*names, "nobody"], ["i0"]):
        pairs = [(a, b) for a in subs for b in sups]
        assert ask(pairs) == {p: true(*p) for p in pairs}
    assert starts == [(len(sups), True), (1, False)]
