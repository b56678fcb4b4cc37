"""Changes and reads in the combined order: reduction, placing, moves, contraction, unions, refinements and excerpts
where containment of values counts.

Containment is computed, never asserted, so it enters a change as hops from each value's nearest
containers; hops take part in every path and are never results themselves. The edge from a head to its
value (the anchor) is schema: it is a step of paths too, but no path makes it redundant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.units import UNITS, Units
from ..session import materialize
from .canonical import entailed as asserted_claims
from .canonical import implied
from .mutation import _rooted, bridge
from .mutation import excerpt as mutation_excerpt
from .queries import absorb, facets, names
from .traversal import ancestors_of, even_join
from .valued import _wide, canonical_names, disjoint_parents, get, held_pairs, is_below, kinds, materialise, values


def nearest_containers(vals: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """(parent, child): for each value of `inner` (default: all of `vals`), the values that hold it with
    no other one between; reachability through them is that of all containments.

    Ranges are swept by falling start: a container is nearest if it ends before all that start later or
    with it. Ends that doubles cannot tell apart are all kept, which costs a hop and changes no path. Of codes the longest is nearest;
    of tuples all containers are given."""
    inner = vals if inner is None else inner
    wide = vals.where(_wide("v")).select(F.col("name").alias("term"), "head", "v")
    pairs = even_join(held_pairs(wide, inner.select("name", "head", "v")), wide.select("term", "v"), "term")  # one range may hold all
    size = lambda end, open_: F.coalesce(F.col(f"v.{end}.n").cast("double") / F.col(f"v.{end}.d").cast("double"), F.lit(open_))
    swept = Window.partitionBy("name").orderBy(F.desc("lo"), "hi", "term")
    before = swept.rowsBetween(Window.unboundedPreceding, -1)
    placed = pairs.withColumns({"lo": size("lo", float("-inf")), "hi": size("hi", float("inf")), "length": F.length("v.code")})
    placed = placed.withColumns({"least": F.min("hi").over(before), "longest": F.max("length").over(Window.partitionBy("name"))})
    near = F.when(F.col("v.code").isNotNull(), F.col("length") == F.col("longest")).when(F.col("v.parts").isNotNull(), True).otherwise(F.col("least").isNull() | (F.col("hi") <= F.col("least") + 1e-9 * F.abs("least")))
    return placed.where(near).select(F.col("term").alias("parent"), F.col("name").alias("child"))


def _anchor(parent: str, child: str) -> str:
    return f"regexp_extract({child}, r'{T.TERM}', 1) = {parent}"


def ancestors(edges: DataFrame, vals: DataFrame, starts: DataFrame) -> DataFrame:
    """(term, name): the strict ancestors of every term of `starts` in the combined order."""
    return ancestors_of(edges.select("parent", "child").unionByName(nearest_containers(vals)), starts)


def reduce_edges(edges: DataFrame, vals: DataFrame) -> DataFrame:
    """The asserted edges that no longer path of the combined order implies; anchors always stay. A cycle
    of asserted edges and containments is refused (ValueError)."""
    own = edges.select("parent", "child")
    both = materialize(own.unionByName(nearest_containers(vals)).distinct())
    gone = implied(both).where(f"NOT ({_anchor('parent', 'child')})")
    return own.join(gone, ["parent", "child"], "left_anti")


def put(edges: DataFrame, batch: DataFrame, units: Units = UNITS) -> DataFrame:
    """`edges` with the batch's claims (parent, child): typed names are spelled canonically, new values hang under their
    heads, and the whole is reduced in the combined order. Refused (ValueError): a value under
    another value of its head, whose order is computed; a head with values of two spaces; an item newly under two
    values of a head that have no common part; a cycle."""
    whole = materialise(edges, batch, units)
    split = lambda c: F.regexp_extract(c, T.TERM, 1)
    asserted = whole.where((split("parent") != "") & (split("parent") == split("child"))).orderBy("parent", "child").limit(5).collect()  # named in the message
    if asserted:
        raise ValueError("the order within a head is computed: " + ", ".join(f"{r['child']} under {r['parent']}" for r in asserted))
    rooted = materialize(_rooted(whole, whole.select(F.col("parent").alias("name"))))
    vals = materialize(values(rooted, units))
    split_up = disjoint_parents(rooted, vals)
    apart = split_up.join(disjoint_parents(edges, values(edges, units)), ["name", "head"], "left_anti").orderBy("name").limit(5).collect()
    if apart:
        raise ValueError("disjoint values: " + ", ".join(f"{r['name']} by {r['head']}" for r in apart))
    return reduce_edges(rooted, vals)


def _refuse(bad: DataFrame, why: str) -> None:
    """ValueError if `bad` has rows; a few of them are named in the message."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{why}: " + ", ".join(" and ".join(map(str, r)) for r in rows))


def move(edges: DataFrame, moved: DataFrame, to: list[str], from_: list[str] | None = None, units: Units = UNITS) -> tuple[DataFrame, DataFrame]:
    """(edges, retracted): the graph with the names of `moved` (name) under all of `to` and no longer under `from_`
    (None: any parent but those of `to`), and the edges (parent, child) that had to be taken back; an edge that the
    new parents imply is none of these. What is left without a parent goes under the root.

    All is checked before anything moves. Refused (ValueError): the root or an unknown name in `moved`; an unknown
    name in `to` that is no value of a typed head, or in `from_`; an item that is not right under all of `from_`, also
    where it is below it; a destination that is the item or below it; and what `put` refuses."""
    own = edges.select("parent", "child")
    heads = materialize(kinds(own))
    listed = own.sparkSession.createDataFrame([(n,) for n in sorted({*to, *(from_ or [])})], "name string")
    said = {r["name"]: r["canonical"] for r in canonical_names(listed, heads, units).collect()}  # those that the caller lists
    to, from_ = [said[n] for n in to], None if from_ is None else [said[n] for n in from_]
    items = materialize(canonical_names(moved.select("name").distinct(), heads, units).select(F.col("canonical").alias("child")).distinct())
    listing = lambda column, names_: F.explode(F.array(*map(F.lit, names_)).cast("array<string>")).alias(column)
    one = own.sparkSession.range(1)
    known = materialize(own.select(F.col("parent").alias("name")).union(own.select("child")).distinct())
    _refuse(items.where(F.col("child") == "*"), "the root does not move")
    _refuse(items.join(known.withColumnRenamed("name", "child"), "child", "left_anti"), "no such name")
    absent = one.select(listing("name", to)).join(known, "name", "left_anti").withColumn("head", F.regexp_extract("name", T.TERM, 1))
    _refuse(absent.join(heads, "head", "left_anti").select("name"), "no such category")
    _refuse(one.select(listing("name", from_ or [])).join(known, "name", "left_anti"), "no such category")
    if from_ is not None:
        loose = materialize(items.select(listing("parent", from_), "child").join(own, ["parent", "child"], "left_anti"))
        if not loose.isEmpty():
            vals = values(own, units)
            deep = is_below(own, vals, loose.select(F.col("child").alias("sub"), F.col("parent").alias("sup")), units).where("below")
            _refuse(deep.select("sub", "sup"), "below, but not right under it")
            _refuse(loose.select("child", "parent"), "not under it")
    new = items.select(listing("parent", to), "child")
    mine = own.join(items, "child", "left_semi").select("parent", "child")
    old = mine.where((F.col("parent") != "*") & ~F.col("parent").isin(to)) if from_ is None else mine.where(F.col("parent").isin(from_))
    old = materialize(old.join(new, ["parent", "child"], "left_anti"))
    # one walk up from the destinations tells of cycles and of old parents that the new ones imply
    ends = items.select(F.col("child").alias("sup")).union(old.select("parent")).distinct()
    above = materialize(is_below(own, values(own, units), ends.select(listing("sub", to), "sup"), units).where("below")) if to else None
    if above is not None:
        _refuse(above.join(items.select(F.col("child").alias("sup")), "sup", "left_semi").select("sub", "sup"), "would be under itself")
        implied_ = above.where("sub <> sup").select(F.col("sup").alias("parent")).distinct()
    rest = own.join(old, ["parent", "child"], "left_anti")
    if from_ is None and to:
        rest = rest.join(items.select(F.lit("*").alias("parent"), "child"), ["parent", "child"], "left_anti")
    done = put(materialize(_rooted(rest, names(own))), new, units)
    return done, old if above is None else old.join(implied_, "parent", "left_anti").select("parent", "child")


def remove(edges: DataFrame, vals: DataFrame, gone: DataFrame) -> DataFrame:
    """`edges` without the names of `gone` (name): what was right below them goes below their parents and, for
    values, below their nearest remaining containers; reduced in the combined order."""
    gone = materialize(gone.select("name").distinct())
    lost = materialize(vals.join(gone, "name", "left_semi"))
    kept = materialize(vals.join(gone, "name", "left_anti"))
    hops = nearest_containers(kept, lost)
    bridged = materialize(bridge(edges.select("parent", "child").unionByName(hops).distinct(), gone))
    return reduce_edges(bridged, kept)


def whole(edges: DataFrame, vals: DataFrame) -> DataFrame:
    """(parent, child): the asserted edges and the hops of containment, whose paths are the combined order."""
    return materialize(edges.select("parent", "child").unionByName(nearest_containers(vals)).distinct())


def get_any(edges: DataFrame, vals: DataFrame, query: list[list[str]], units: Units = UNITS) -> DataFrame:
    """(name) in any of the conjunctions, whose typed terms need not be present; none: nothing."""
    parts = [get(edges, vals, terms, units) for terms in absorb(query)]
    return reduce(DataFrame.union, parts).distinct() if parts else names(edges).limit(0)


def refinements(edges: DataFrame, vals: DataFrame, terms: list[str], category: str, units: Units = UNITS) -> DataFrame:
    """(term, n): what lies right below a category and narrows the answer to `terms` without emptying it. Below
    a value these are its own items and the values that it holds nearest."""
    both = whole(edges, vals)
    members = materialize(get(edges, vals, terms, units))
    anchors = F.col("parent") == F.regexp_extract("child", T.TERM, 1)
    inner = both.where(F.col("parent") == category)
    if T.split_term(category) is None:  # a head shows the values that no other one holds, its other children as they are
        held = both.where(~anchors & F.col("child").rlike(T.TERM) & F.col("parent").rlike(T.TERM)).select("child").distinct()
        inner = inner.where(~anchors).unionByName(inner.where(anchors).join(held, "child", "left_anti"))
    return facets(both, members, inner.select(F.col("child").alias("term")).distinct())


def entailed(edges: DataFrame, vals: DataFrame, scope: DataFrame) -> DataFrame:
    """(sup, sub): claims of the combined order with both ends in `scope` (name)."""
    return asserted_claims(whole(edges, vals), scope)


def excerpt(edges: DataFrame, vals: DataFrame, answer: DataFrame, context: bool = False) -> DataFrame:
    """The graph of an answer (name): its asserted edges, reduced as they were; with `context` also everything above it
    in the combined order. A typed value brings its head, so that it keeps its meaning."""
    chosen = answer.select("name").distinct()
    if context:
        chosen = chosen.union(ancestors_of(whole(edges, vals), chosen.select(F.col("name").alias("term"))).select("name")).distinct()
    chosen = materialize(chosen)
    heads = vals.join(chosen, "name", "left_semi").select(F.col("head").alias("name")).distinct()
    kinds = ancestors_of(edges, heads.select(F.col("name").alias("term"))).select("name")
    return mutation_excerpt(edges, chosen.union(heads).union(kinds).distinct())
