"""The combined order: asserted edges, and the containment of values under one typed head.

A head is typed by a kind node above it. Its values are the names `head(...)` that hang under it; a value
is below every value of the head that contains it, present or only asked for. Containment is never
stored as pairs: a walk that meets values joins them on the head with the head's values, and only values
that can contain others (ranges, codes, tuples) look for more. Ranges meet values by ranks (ranges.py), codes
by their prefixes, so a head with all values is spread like many heads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.units import UNITS, Units, declared
from ..session import materialize
from .dominance import dominance_join
from .queries import names
from .ranges import points_in_ranges
from .traversal import ancestors_of, cones, descendants, spread

KIND_NODES = {f"{k}-dimension": k for k in T.KINDS}
UNIT_DECLARATION = "unit-declaration"


def _typed(c: str) -> Column:
    """Whether a name is spelled like a typed term; most names have no bracket and are told apart by that."""
    return F.col(c).contains("(") & F.col(c).rlike(T.TERM)


def declared_units(edges: DataFrame) -> Units:
    """The built-in units and those declared under UNIT_DECLARATION (few names, read by the driver)."""
    found = edges.where(F.col("parent") == UNIT_DECLARATION).select("child").distinct().orderBy("child").collect()
    return declared([r[0] for r in found]) if found else UNITS


def kinds(edges: DataFrame) -> DataFrame:
    """(head, kind) of every name that a kind node leads to without passing a value; `conflict` for one
    below two kinds, whose values are then refused."""
    plain = edges.where(~_typed("parent") & ~_typed("child"))
    found = descendants(plain, *KIND_NODES).groupBy(F.col("name").alias("head")).agg(F.min("term").alias("a"), F.max("term").alias("b"))
    return found.select("head", F.when(F.col("a") == F.col("b"), F.regexp_replace("a", "-dimension$", "")).otherwise("conflict").alias("kind"))


def heads_in_use(edges: DataFrame) -> DataFrame:
    """(head, kind) of the typed heads that some value names: plain items under a head are none."""
    used = edges.where(_typed("child")).select(F.regexp_extract("child", T.TERM, 1).alias("head")).distinct()
    return kinds(edges).join(used, "head", "left_semi")


def values(edges: DataFrame, units: Units = UNITS) -> DataFrame:
    """(name, head, kind, v): the values of every typed head, parsed."""
    stars = edges.where(_typed("child")).withColumn("head", F.regexp_extract("child", T.TERM, 1)).where("head = parent")
    return stars.join(heads_in_use(edges), "head").select(F.col("child").alias("name"), "head", "kind", T.parsed(F.col("child"), F.col("kind"), units).alias("v"))


def canonical_names(terms: DataFrame, heads: DataFrame, units: Units = UNITS) -> DataFrame:
    """`terms` (name, ...) with canonical: a typed term's spelling, any other name as it is; a term that
    its head's kind refuses stops the query with the reason."""
    typed = terms.withColumn("head", F.regexp_extract("name", T.TERM, 1)).join(heads, "head", "left").withColumn("v", T.parsed(F.col("name"), F.col("kind"), units))
    spelled = F.when(F.col("kind").isNull(), F.col("name")).when(F.col("v.error").isNull(), F.col("v.canonical")).otherwise(F.raise_error(F.concat("name", F.lit(": "), "v.error")))
    return typed.withColumn("canonical", spelled).drop("head", "kind", "v")


def spaces(vals: DataFrame) -> DataFrame:
    """(head, spaces, sound): the value spaces of each head; more than one is unsound."""
    return vals.groupBy("head").agg(F.array_join(F.array_sort(F.collect_set("v.space")), " ").alias("spaces"), (F.countDistinct("v.space") == 1).alias("sound"))


def materialise(edges: DataFrame, claims: DataFrame, units: Units = UNITS) -> DataFrame:
    """`edges` with claims (parent, child) whose typed names are spelled canonically, and an edge from
    its head to every new value. A head that would get values of two spaces is refused (ValueError)."""
    return materialised(edges, claims, units)[0]


def materialised(edges: DataFrame, claims: DataFrame, units: Units = UNITS) -> tuple[DataFrame, DataFrame]:
    """What `materialise` gives, and its `values`. Only typed names are read and joined with their spellings."""
    heads = materialize(kinds(edges))
    claims = materialize(claims.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL"))
    ends = claims.select(F.explode(F.array("parent", "child")).alias("name")).where(_typed("name")).distinct()
    ends = ends.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # reading costs far more than a name's bytes tell
    spelled = materialize(canonical_names(ends, heads, units))

    def said(rows: DataFrame, c: str) -> DataFrame:
        typed = rows.where(_typed(c)).join(spelled.select(F.col("name").alias(c), "canonical"), c).withColumn(c, F.col("canonical"))
        return rows.where(~_typed(c)).select("parent", "child").union(typed.select("parent", "child"))

    anchors = spelled.select(F.regexp_extract("canonical", T.TERM, 1).alias("parent"), F.col("canonical").alias("child")).join(heads, F.col("parent") == F.col("head")).select("parent", "child")
    both = materialize(edges.select("parent", "child").union(said(said(claims, "parent"), "child")).union(anchors).distinct())
    vals = materialize(values(both, units))
    bad = spaces(vals).where("NOT sound").orderBy("head").limit(5).collect()  # named in the message
    if bad:
        raise ValueError("; ".join(f"{r['head']}: {r['spaces']}" for r in bad))
    return both, vals


def disjoint_parents(edges: DataFrame, vals: DataFrame) -> DataFrame:
    """(name, head): items right under two values of one head that have no common part. Only an item's
    own value parents are compared, the least end with the greatest start among them."""
    own = edges.join(vals.select(F.col("name").alias("parent"), "head", "v"), "parent").where("child <> head")
    pairs = own.select("child", "head", F.col("v").alias("a")).join(own.select("child", "head", F.col("v").alias("b")), ["child", "head"])
    return pairs.where(~T.overlaps(F.col("a"), F.col("b"))).select(F.col("child").alias("name"), "head").distinct()


def held_pairs(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(term, name): every value of `outer` (term, head, v) with every other value of `inner` (name, head, v) inside it.

    Ranges are joined by ranks: an end's double, moved outwards by far more than its rounding, proposes,
    and the exact ratios decide. A code is looked up by its prefixes, tuples are joined on a grid of cells."""
    here = {r[0] for r in outer.select(_form("v")).distinct().collect()}  # three at most
    ratio = lambda x: x["n"].cast("double") / x["d"].cast("double")
    near = lambda v, end, sign: ratio(v[end]) + sign * 1e-9 * F.abs(ratio(v[end]))
    both = lambda rows, form: rows.where(_form("v") == form).withColumn("space", F.col("v.space"))
    exact = lambda r, p: (r["term"] != p["name"]) & T.contains(r["v"], p["v"])
    out = []
    if "range" in here:
        ranges = both(outer, "range").withColumns({"lo": near(F.col("v"), "lo", -1), "hi": near(F.col("v"), "hi", 1)})
        points = both(inner, "range").withColumn("at", near(F.col("v"), "lo", 0))
        out.append(points_in_ranges(points, ranges, ["head", "space"], "at", "lo", "hi", test=exact))
    if "tuple" in here:
        at = lambda rows: both(rows, "tuple").withColumn("point", F.transform("v.parts", ratio))
        out.append(dominance_join(at(outer), at(inner), ["head", "space"], "point", exact))
    found = [x.select("r.term", "p.name") for x in out]
    if "code" in here:
        codes = outer.where(_form("v") == "code").select("term", "head", F.col("v.code").alias("prefix"))
        longer = F.explode(F.transform(F.sequence(F.lit(1), F.length("v.code")), lambda n: F.substring(F.col("v.code"), F.lit(1), n)))
        found.append(inner.where(_form("v") == "code").select("name", "head", longer.alias("prefix")).join(codes, ["head", "prefix"]).where("term <> name").select("term", "name"))
    if not found:
        return outer.sparkSession.createDataFrame([], "term string, name string")
    return reduce(DataFrame.unionAll, found)


def computed_children(vals: DataFrame, outer: DataFrame) -> DataFrame:
    """(term, name): values inside each value of `outer` (term, head, v), itself left out."""
    return held_pairs(outer, vals.select("name", "head", "v"))


def computed_parents(vals: DataFrame, inner: DataFrame) -> DataFrame:
    """(term, name): values that hold each value of `inner` (term, head, v), itself left out."""
    wide = vals.where(_wide("v")).select(F.col("name").alias("term"), "head", "v")
    return held_pairs(wide, inner.select(F.col("term").alias("name"), "head", "v")).select(F.col("name").alias("term"), F.col("term").alias("name"))


def _form(v: str) -> Column:
    return F.when(F.col(f"{v}.code").isNotNull(), "code").when(F.col(f"{v}.parts").isNotNull(), "tuple").when(F.col(f"{v}.space").isNotNull(), "range")


def _wide(v: str) -> str:
    """SQL: whether a value can hold others; points cannot."""
    return f"({v}.code IS NOT NULL OR {v}.parts IS NOT NULL OR NOT {v}.lo <=> {v}.hi)"


def combined_cones(edges: DataFrame, vals: DataFrame, starts: DataFrame) -> DataFrame:
    """(term, name): strict descendants of every term in the combined order."""
    vals = materialize(vals)
    wide = vals.where(_wide("v")).select(F.col("name").alias("term"), "head", "v")
    hops = materialize(computed_children(vals, wide)).select(F.col("term").alias("parent"), F.col("name").alias("child")) if not wide.isEmpty() else None
    return cones(edges.select("parent", "child") if hops is None else edges.select("parent", "child").union(hops).distinct(), starts)


def _asked(edges: DataFrame, terms: list[str], units: Units) -> dict[str, tuple[str, T.Value]]:
    """The typed ones of the terms: (head, value)."""
    split = {t: T.split_term(t) for t in terms}
    wanted = sorted({x[0] for x in split.values() if x})
    kind = {r["head"]: r["kind"] for r in kinds(edges).where(F.col("head").isin(wanted)).collect()} if wanted else {}  # a row a head asked for
    return {t: (x[0], T.read(x[1], kind[x[0]], units)) for t, x in split.items() if x and x[0] in kind}


def _held(vals: DataFrame, head: str, value: T.Value, test) -> DataFrame:
    """(term): the values of a head that pass a test against a value."""
    one = vals.sparkSession.createDataFrame([(f"{head}({T.write(value)})", value.kind)], "a string, k string").select(T.parsed(F.col("a"), F.col("k")).alias("asked"))
    return vals.where(F.col("head") == head).join(F.broadcast(one), test(F.col("asked"), F.col("v"))).select(F.col("name").alias("term"))  # one row


def virtual_cone(edges: DataFrame, vals: DataFrame, head: str, value: T.Value) -> DataFrame:
    """(name): the present values inside a value that need not be present, and all that is below them."""
    inside = materialize(_held(vals, head, value, T.contains))
    inside = inside.select(F.lit("").alias("term"), F.col("term").alias("name"))  # one walk of names, not one for each value
    return inside.union(spread(edges, inside)).select("name").distinct()


def overlapping(edges: DataFrame, vals: DataFrame, term: str, units: Units = UNITS) -> DataFrame:
    """(name): what possibly satisfies a typed term: the values that share a part with it, and all that
    is below them. ValueError for a term of no typed head."""
    asked = _asked(edges, [term], units)
    if not asked:
        raise ValueError(f"{term}: not a value of a typed head")
    met = materialize(_held(vals, *asked[term], T.overlaps))
    met = met.select(F.lit("").alias("term"), F.col("term").alias("name"))
    return met.union(spread(edges, met)).select("name").distinct()


def get(edges: DataFrame, vals: DataFrame, terms: list[str], units: Units = UNITS) -> DataFrame:
    """(name) below all terms in the combined order; typed terms need not be present, and those of one
    head are met first. A value asked for as such is no answer to itself. No terms: everything."""
    vals = materialize(vals)
    wanted = sorted(set(terms) - {"*"})
    asked, typed = _asked(edges, wanted, units), {}
    plain = [t for t in wanted if t not in asked]
    for head, value in asked.values():
        if head in typed:
            value = typed[head] and T.meet(typed[head], value)
        typed[head] = value
    if any(v is None for v in typed.values()):
        return names(edges).limit(0)
    out = None
    for head, value in typed.items():
        cone = virtual_cone(edges, vals, head, value).where(F.col("name") != f"{head}({T.write(value)})")
        out = cone if out is None else out.join(cone, "name", "left_semi")
    if plain:
        start = edges.sparkSession.createDataFrame([(t,) for t in plain], "term string")
        every = combined_cones(edges, vals, start).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(plain)).select("name")
        out = every if out is None else out.join(every, "name", "left_semi")
    return names(edges) if out is None else out


def is_below(edges: DataFrame, vals: DataFrame, pairs: DataFrame, units: Units = UNITS) -> DataFrame:
    """(sub, sup, below) in the combined order, either of them a present name or a value of a typed head;
    an unknown name is below nothing, and nothing below it."""
    heads = materialize(kinds(edges))
    vals = materialize(vals)
    ends = pairs.select(F.col("sub").alias("name")).union(pairs.select("sup")).distinct()
    typed = ends.withColumn("head", F.regexp_extract("name", T.TERM, 1)).join(heads, "head").select("name", "head", T.parsed(F.col("name"), F.col("kind"), units).alias("v"))
    typed = materialize(typed.where("v.error IS NULL"))
    # asked values join the present ones for the walk, under their heads
    more = typed.select(F.col("head").alias("parent"), F.col("v.canonical").alias("child"))
    spelled = pairs.join(typed.select(F.col("name").alias("sub"), F.col("v.canonical").alias("_sub")), "sub", "left").join(typed.select(F.col("name").alias("sup"), F.col("v.canonical").alias("_sup")), "sup", "left")
    spelled = materialize(spelled.select("sub", "sup", F.coalesce("_sub", "sub").alias("_sub"), F.coalesce("_sup", "sup").alias("_sup")))
    whole = materialize(edges.select("parent", "child").union(more).distinct())
    every = materialize(vals.select("name", "head", "v").union(typed.select("v.canonical", "head", "v")).dropDuplicates(["name"]))
    subs, sups = spelled.agg(F.approx_count_distinct("_sub"), F.approx_count_distinct("_sup")).first()
    down = sups <= subs  # the walk begins at the side with fewer names
    start, other = ("_sup", "_sub") if down else ("_sub", "_sup")
    starts = spelled.select(F.col(start).alias("term"), F.col(start).alias("name")).distinct()
    reached = _reached(whole, every, starts, down)
    own = spelled.where("_sub = _sup OR _sup = '*'").join(names(whole).withColumnRenamed("name", "_sub"), "_sub", "left_semi").select("_sub", "_sup")
    yes = reached.select(F.col("term").alias(start), F.col("name").alias(other)).select("_sub", "_sup").union(own).distinct().withColumn("_in", F.lit(True))
    return spelled.join(yes, ["_sub", "_sup"], "left").select("sub", "sup", F.coalesce("_in", F.lit(False)).alias("below"))


def _reached(whole: DataFrame, every: DataFrame, starts: DataFrame, down: bool) -> DataFrame:
    """(term, name): what is strictly below, or above, the names of `starts` (term, name) in the combined order.

    Containment is transitive, so a value takes one hop into all that it holds, or that hold it, and then goes on by
    edges; what those reach may be a value of another head, which takes its own hop in the next round."""
    wide = every.where(_wide("v"))
    own = whole if down else whole.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    reached = front = spread(own, starts)
    front = materialize(front.union(starts).distinct())
    while True:
        hop = materialize((wide if down else every).join(front.select("name").distinct(), "name", "left_semi"))  # each value met on the way once
        if hop.isEmpty():
            return reached
        outer, inner = (hop, every) if down else (wide, hop)
        held = held_pairs(outer.select(F.col("name").alias("term"), "head", "v"), inner)
        held = held.select(F.col("term").alias("name"), F.col("name").alias("to")) if down else held.select("name", F.col("term").alias("to"))
        inside = front.join(held, "name").select("term", F.col("to").alias("name")).distinct()
        inside = materialize(inside.join(reached, ["term", "name"], "left_anti"))
        if inside.isEmpty():
            return reached
        far = spread(own, inside)
        reached, before = reached.union(inside), reached.union(inside)
        front = materialize(far.join(before, ["term", "name"], "left_anti"))
        reached = reached.union(front)
