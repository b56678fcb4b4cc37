"""Registered queries of the category engine over the standard tables, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import contains, dominates, overlaps, period
from .functions import terms as T
from .functions.sql import register
from .operators.dominance import dominance_join
from .operators.group_store import GroupStore
from .operators import adoption, browse, canonical, certificates, combined, contexts, deltas, indexes, mutation, provenance, queries as q, ranges, traversal, valued, versions
from .plans import vocabulary
from .plans.graph import EDGES_SQL, LINES_SQL, edges
from .session import materialize, shared_dir, table
from .sources.text import dot, manchester_frames, owl_classes, projection_edges

_E = f"WITH RECURSIVE e AS ({EDGES_SQL})"
_EL = f"WITH RECURSIVE e AS ({EDGES_SQL}{LINES_SQL})"


def _cone(name: str, *terms: str) -> str:
    seeds = ", ".join(f"'{t}'" for t in terms)
    return f"{name} AS (SELECT parent AS term, child AS name FROM e WHERE parent IN ({seeds}) UNION SELECT c.term, e.child FROM {name} c JOIN e ON e.parent = c.name)"


_CLOSURE = "p AS (SELECT parent AS a, child AS d FROM e UNION SELECT p.a, e.child FROM p JOIN e ON e.parent = p.d)"


def cone(spark: SparkSession, d: str) -> DataFrame:
    return traversal.descendants(edges(spark, d, lines=True), "region:ASIA").select("name")


def conjunction(spark: SparkSession, d: str) -> DataFrame:
    return q.get(edges(spark, d, lines=True), ["region:ASIA", "segment:BUILDING"])


def union_of_conjunctions(spark: SparkSession, d: str) -> DataFrame:
    return q.get_any(edges(spark, d), [["region:ASIA", "segment:BUILDING"], ["nation:NATION_7"], ["nation:NATION_7", "segment:BUILDING"]])


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return traversal.ancestors(edges(spark, d), "order:1", "order:2").select("term", "name")


def closure(spark: SparkSession, d: str) -> DataFrame:
    return traversal.closure(edges(spark, d))


def is_below(spark: SparkSession, d: str) -> DataFrame:
    """Every order against every region, itself, the root and a name that is not there."""
    order = F.concat(F.lit("order:"), "o_orderkey")
    sups = F.concat(F.transform(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), lambda x: F.concat(F.lit("region:"), x)), F.array(order, F.lit("*"), F.lit("nobody")))
    pairs = table(spark, d, "orders").select(order.alias("sub"), F.explode(sups).alias("sup")).unionByName(spark.createDataFrame([("nobody", "nobody"), ("region:ASIA", "region:ASIA")], "sub string, sup string"))
    return q.is_below(edges(spark, d), pairs.distinct())


def transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    extra = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shortcut = extra.select(F.concat(F.lit("region:"), "r_name").alias("parent"), F.concat(F.lit("cust:"), "c_custkey").alias("child"))
    return canonical.merge(edges(spark, d), shortcut)


def descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.descendant_counts(edges(spark, d))


def refinements(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return q.refinements(e, q.get(e, ["segment:BUILDING"]), "*")


def name_completion(spark: SparkSession, d: str) -> DataFrame:
    return q.complete(edges(spark, d), "Nation:")


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return traversal.neighbourhood(edges(spark, d), "nation:NATION_7", 2)


def _two_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Without the orders; and without what is under regions, but with each customer under its region,
    which the first graph implies."""
    e = edges(spark, d)
    region = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    direct = table(spark, d, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("region:"), "r_name").alias("parent"), F.concat(F.lit("cust:"), "c_custkey").alias("child"))
    return e.where("child NOT LIKE 'order:%'"), e.where("parent NOT LIKE 'region:%'").unionByName(direct)


def compare_graphs(spark: SparkSession, d: str) -> DataFrame:
    return canonical.compare(*_two_graphs(spark, d))


def additions_fragment(spark: SparkSession, d: str) -> DataFrame:
    return canonical.additions(*_two_graphs(spark, d))


def cascade_sizes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.cascade(*_two_graphs(spark, d))


def entailed_claims(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return canonical.entailed(e, q.names(e).where("name NOT LIKE 'order:%'"))


def records(spark: SparkSession, d: str) -> DataFrame:
    done = canonical.records(edges(spark, d))
    return done.select("name", F.array_join("up", "|").alias("up"), F.array_join("down", "|").alias("down"))


def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    lo = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, d, "orders").where(contains(F.lit(1000).cast("decimal(18,2)"), F.lit(50000).cast("decimal(18,2)"), lo, lo)).select("o_orderkey")


def calendar_overlap(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = period(F.lit("1995-03"))
    day = F.col("o_orderdate")
    return table(spark, d, "orders").where(overlaps(lo, hi, day, day + F.expr("INTERVAL 10 DAYS"))).select("o_orderkey")


def dominance(spark: SparkSession, d: str) -> DataFrame:
    box = F.array(F.col("p_size"), F.lit(20), F.lit(10))
    return table(spark, d, "part").where(dominates(F.array(F.lit(30), F.lit(25), F.lit(10)), box)).select("p_partkey")


def projection_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("item"), F.array(F.concat(F.lit("sys:lang:"), "lang"), F.concat(F.lit("sys:src:"), "source")).alias("supercategories"))
    return projection_edges(rows)


def implications(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    obj = F.concat(F.lit("cust:"), "o_custkey")
    rows = orders.select(obj.alias("obj"), F.concat(F.lit("status:"), "o_orderstatus").alias("attr")).union(orders.select(obj, F.concat(F.lit("priority:"), "o_orderpriority")))
    home = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("cust:"), "c_custkey").alias("obj"), "c_mktsegment", "n_name", "r_name")
    attrs = people.select("obj", F.explode(F.array(F.concat(F.lit("segment:"), "c_mktsegment"), F.concat(F.lit("nation:"), "n_name"), F.concat(F.lit("region:"), "r_name"))))
    return canonical.implications(rows.union(attrs))


def _named(df: DataFrame, pattern: str) -> DataFrame:
    return q.names(df).where(F.col("name").like(pattern))


def _wealthy(spark: SparkSession, d: str) -> DataFrame:
    """A batch to place: a new category over the customers with a balance above 5000."""
    rich = table(spark, d, "customer").where("c_acctbal > 5000")
    return rich.select(F.lit("wealthy").alias("parent"), F.concat(F.lit("cust:"), "c_custkey").alias("child"))


def put_batch(spark: SparkSession, d: str) -> DataFrame:
    return mutation.put(edges(spark, d), _wealthy(spark, d))


def contraction(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return mutation.remove(e, _named(e, "nation:%").unionByName(_named(e, "cust:%")))


def cone_removal_plan(spark: SparkSession, d: str) -> DataFrame:
    return mutation.cone_removal_plan(edges(spark, d), "region:ASIA", "segment:BUILDING")


def remove_cone(spark: SparkSession, d: str) -> DataFrame:
    return mutation.remove_cone(edges(spark, d), "region:ASIA", "segment:BUILDING")


def move(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return mutation.reclassify(e, e.where("parent = 'segment:BUILDING'").select(F.col("child").alias("name")), ["segment:MACHINERY"], ["segment:BUILDING"])


def excerpt(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return mutation.excerpt(e, q.get(e, ["region:ASIA", "segment:BUILDING"]))


def excerpt_with_context(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return mutation.excerpt(e, q.get(e, ["region:ASIA", "segment:BUILDING"]), context=True)


def copy_below(spark: SparkSession, d: str) -> DataFrame:
    return mutation.copy_below(edges(spark, d), "region:ASIA", "nation:NATION_7")


def prune_to_common(spark: SparkSession, d: str) -> DataFrame:
    return mutation.prune_to_common(edges(spark, d), "region:ASIA", "segment:BUILDING")


def contested(spark: SparkSession, d: str) -> DataFrame:
    return q.contested(edges(spark, d), "region:ASIA", "segment:BUILDING")


def focus(spark: SparkSession, d: str) -> DataFrame:
    return q.focus(edges(spark, d), "nation:NATION_7")


def narrowing(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return q.narrowing(e, q.get(e, ["segment:BUILDING", "region:ASIA"]), ["segment:BUILDING", "region:ASIA"])


def cone_index(spark: SparkSession, d: str) -> DataFrame:
    return q.broad_cones(edges(spark, d), 64)


def counts_by_delta(spark: SparkSession, d: str) -> DataFrame:
    """Descendant counts after a batch: rich customers placed under a new category, those in debt out of their segment."""
    e = edges(spark, d)
    debt = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("parent"), F.concat(F.lit("cust:"), "c_custkey").alias("child"))
    more = _wealthy(spark, d).unionByName(spark.createDataFrame([("*", "wealthy")], "parent string, child string"))
    return deltas.update_counts(canonical.descendant_counts(e), indexes.EdgeIndex(e), more, debt)


def diff_by_groups(spark: SparkSession, d: str) -> DataFrame:
    """(name, change) between two versions of a store, the second made by a batch: customers in debt leave their segment."""
    store = GroupStore(spark, f"{shared_dir(spark)}/conegrid-{uuid4().hex}", digits=2)
    debt = table(spark, d, "customer").where("c_acctbal < -900").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("parent"), F.concat(F.lit("cust:"), "c_custkey").alias("child"))
    before = store.commit(edges(spark, d))
    return store.diff(before, store.commit_batch(spark.createDataFrame([("*", "added")], "parent string, child string"), debt))


def dominance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(nation, part): which parts fit into a box that a nation's number gives; sides in any order."""
    size = lambda *sides: F.reverse(F.array_sort(F.array(*[F.col(s).cast("double") if isinstance(s, str) else F.lit(float(s)) for s in sides])))
    boxes = table(spark, d, "nation").withColumn("twice", F.col("n_nationkey") * 2).select(F.lit(1).alias("g"), "n_name", size("n_nationkey", "twice", 12).alias("at"))
    parts = table(spark, d, "part").where("p_size IS NOT NULL").select(F.lit(1).alias("g"), "p_partkey", size("p_size", 20, 10).alias("at"))
    fits = lambda r, p: F.forall(F.arrays_zip(r["at"].alias("r"), p["at"].alias("p")), lambda x: x["p"] <= x["r"])
    return dominance_join(boxes, parts, ["g"], "at", fits).select(F.col("r.n_name").alias("nation"), F.col("p.p_partkey").alias("part"))


_INDEXED = ["region:ASIA", "segment:BUILDING", "nation:NATION_7", "cust:1", "nobody"]


def cones_from_index(spark: SparkSession, d: str) -> DataFrame:
    """(way, term, name): cones from the published index, and from one that is stale, so by walking."""
    e, path = edges(spark, d), f"{shared_dir(spark)}/conegrid-{uuid4().hex}"
    root = indexes.publish_cones(e, path)
    fresh, stale = indexes.ConeIndex(spark, path, root), indexes.ConeIndex(spark, path, "another")
    return fresh.cones(e, _INDEXED).withColumn("way", F.lit("index")).unionByName(stale.cones(e, _INDEXED).withColumn("way", F.lit("walk")))


def walk_or_probe(spark: SparkSession, d: str) -> DataFrame:
    """The nation is the smallest cone, and cheaper to probe upwards than the segment is to walk."""
    e = edges(spark, d)
    return indexes.planned_conjunction(indexes.EdgeIndex(e), canonical.descendant_counts(e), ["segment:BUILDING", "nation:NATION_7"], depth=4)


def optimised_put(spark: SparkSession, d: str) -> DataFrame:
    """(item, parent): an item for each nation, said to be of the nation and of a segment."""
    e = edges(spark, d)
    nation = table(spark, d, "nation").select(F.concat(F.lit("new:"), "n_name").alias("item"), F.explode(F.array(F.concat(F.lit("nation:"), "n_name"), F.lit("segment:BUILDING"))).alias("parent"))
    return indexes.optimised_supers(e, nation)


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Written in SQL: the customers of each region by a lateral table function, whether the region's first nation by
    name is below it, and a range that holds its key."""
    e, path = edges(spark, d), f"{shared_dir(spark)}/conegrid-{uuid4().hex}"
    index = indexes.ConeIndex(spark, path, indexes.publish_cones(e.where("child NOT LIKE 'order:%'"), path, threshold=1))
    every = e.where("parent LIKE 'region:%' OR parent LIKE 'nation:%'").select("parent").distinct()
    register(spark, index.rows([r[0] for r in every.collect()]))  # a name a region or nation
    return spark.sql(
        """SELECT r.r_name AS region, count(c.name) AS customers, below('nation:' || min(n.first), 'region:' || r.r_name) AS first_below,
                  canon('key(' || r.r_regionkey || '..)', 'linear') AS spelled, holds('key(2..)', 'key(' || r.r_regionkey || ')', 'linear') AS held
           FROM {region} r JOIN (SELECT n_regionkey, min(n_name) AS first FROM {nation} GROUP BY n_regionkey) n ON n.n_regionkey = r.r_regionkey,
                LATERAL cone('region:' || r.r_name) c
           WHERE c.name LIKE 'cust:%' GROUP BY r.r_name, r.r_regionkey""",
        region=table(spark, d, "region"), nation=table(spark, d, "nation"),
    )


def topological_order(spark: SparkSession, d: str) -> DataFrame:
    return traversal.topological_order(edges(spark, d))


def ancestors_around(spark: SparkSession, d: str) -> DataFrame:
    """What is above the customers in debt without the way through their nation."""
    e = edges(spark, d)
    debt = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("cust:"), "c_custkey").alias("term"))
    return traversal.ancestors_around(e, debt, _named(e, "nation:%"))


def _declares(spark: SparkSession, d: str, factor: str) -> DataFrame:
    """A unit for every nation, declared with a factor of the table."""
    unit = F.concat(F.lit("unit(u"), "n_nationkey", F.lit("="), F.expr(f"{factor} + 1"), F.lit("kg)"))
    return table(spark, d, "nation").select(F.lit("unit-declaration").alias("parent"), unit.alias("child")).unionByName(spark.createDataFrame([("*", "unit-declaration")], "parent string, child string"))


def merge_preview(spark: SparkSession, d: str) -> DataFrame:
    """Ours: customers and units. Theirs: cities under nations, those of one region under a market, and units defined otherwise."""
    ours = edges(spark, d).where("child NOT LIKE 'order:%'").select("parent", "child").unionByName(_declares(spark, d, "n_nationkey"))
    at = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.concat(F.lit("nation:"), "n_name")
    filed = at.select(F.when(F.col("r_name") == "ASIA", "market").otherwise(F.concat(F.lit("region:"), "r_name")).alias("parent"), nation.alias("child"))
    cities = at.select(nation.alias("parent"), F.concat(F.lit("city:"), "n_name").alias("child"))
    tops = filed.select(F.lit("*").alias("parent"), F.col("parent").alias("child")).distinct()
    return adoption.preview(ours, filed.unionByName(cities).unionByName(tops).unionByName(_declares(spark, d, "n_regionkey")))


def checked_move(spark: SparkSession, d: str) -> DataFrame:
    """(part, parent, child): a segment's customers moved to another one and to a range of prices that is new; the edges then, and those taken back."""
    head = spark.createDataFrame([("*", "linear-dimension"), ("linear-dimension", "price")], "parent string, child string")
    e = edges(spark, d).where("child NOT LIKE 'order:%'").select("parent", "child").unionByName(head)
    moved = e.where("parent = 'segment:BUILDING'").select(F.col("child").alias("name"))
    done, gone = combined.move(e, moved, ["segment:MACHINERY", "price(10.00..20)"], ["segment:BUILDING"])
    return done.withColumn("part", F.lit("edge")).unionByName(gone.withColumn("part", F.lit("retracted")))


def topological_levels(spark: SparkSession, d: str) -> DataFrame:
    return traversal.levels(edges(spark, d, lines=True))


def ancestor_codes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.codes(edges(spark, d)).select("name", F.array_join("code", "|").alias("code"))


def code_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return canonical.cover_edges(canonical.codes(edges(spark, d)))


def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return versions.record_hashes(edges(spark, d)).select("name", "hash")


def changed_records(spark: SparkSession, d: str) -> DataFrame:
    before = edges(spark, d)
    return versions.changed(versions.record_hashes(before.where("parent <> 'segment:BUILDING'")), versions.record_hashes(before.where("child NOT LIKE 'nation:%'")))


def reclassified(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return versions.recoded(canonical.codes(e), canonical.codes(e.where("parent <> 'segment:BUILDING'")))


def provenance_standing(spark: SparkSession, d: str) -> DataFrame:
    act = F.when(F.col("event_type") == "refund", "retract").otherwise("assert")
    acts = table(spark, d, "events").select(F.col("event_type").alias("subject"), F.col("user_id").cast("string").alias("author"), act.alias("act"))
    return versions.standing(acts, ["1", "2", "3"])


def provenance_acts(spark: SparkSession, d: str) -> DataFrame:
    """How many acts each author has on each claim, after two stores with common acts unite."""
    e = table(spark, d, "events")
    claims = provenance.subjects(e.select(F.concat(F.lit("user:"), "user_id").alias("sub"), F.concat(F.lit("did:"), "event_type").alias("sup"), "event_id"))
    kind = F.when(F.col("event_id") % 3 == 0, "endorse").otherwise("assert")
    store = provenance.acts(claims.select("subject", F.col("sub").alias("author"), kind.alias("act"), F.col("event_id").cast("string").alias("basis")))
    both = provenance.unite(store, store.where("act = 'assert'"))
    return provenance.about(both, claims.select("sub", "sup")).groupBy("sub", "sup", "act").agg(F.count("*").alias("n"))


def owl_lines(spark: SparkSession, d: str) -> DataFrame:
    return owl_classes(edges(spark, d))


def manchester(spark: SparkSession, d: str) -> DataFrame:
    return manchester_frames(edges(spark, d))


def dot_lines(spark: SparkSession, d: str) -> DataFrame:
    return dot(edges(spark, d))


#: A typed part of the graph: heads under their kinds, ranges under categories of their own.
_TYPED = [("*", "dimension"), *(("dimension", f"{k}-dimension") for k in ("linear", "calendar", "count", "dominance", "prefix")), ("linear-dimension", "price"), ("calendar-dimension", "time"),
          ("count-dimension", "lines"), ("dominance-dimension", "box"), ("prefix-dimension", "geo"), ("*", "bargain"), ("*", "costly"), ("*", "early"), ("price", "price(..50000)"), ("bargain", "price(..50000)"),
          ("price", "price(200000..)"), ("costly", "price(200000..)"), ("time", "time(..1993)"), ("early", "time(..1993)")]
_valued: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _typed_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges, values): orders under their prices, days and counts of lines, parts under their boxes,
    customers under codes of region and nation."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _valued:
        orders, parts = table(spark, d, "orders"), table(spark, d, "part")
        order = F.concat(F.lit("order:"), "o_orderkey")
        named = lambda head, c: F.concat(F.lit(f"{head}("), c, F.lit(")"))
        n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("string").alias("n"))
        home = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        claims = orders.select(named("price", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("parent"), order.alias("child"))
        claims = claims.union(orders.select(named("time", F.date_format("o_orderdate", "yyyy-MM-dd")), order))
        claims = claims.union(orders.join(n, "o_orderkey").select(named("lines", F.col("n")), order))
        claims = claims.union(parts.select(named("box", F.concat(F.col("p_size").cast("string"), F.lit("x20x10cm"))), F.concat(F.lit("part:"), "p_partkey")))
        claims = claims.union(home.select(named("geo", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("n"), F.col("n_nationkey").cast("string"))), F.concat(F.lit("cust:"), "c_custkey")))
        _valued[key] = valued.materialised(spark.createDataFrame(_TYPED, "parent string, child string"), claims.union(edges(spark, d).where("parent LIKE 'segment:%' OR parent LIKE 'cust:%'").select("parent", "child")))
    return _valued[key]


def canonical_units(spark: SparkSession, d: str) -> DataFrame:
    heads = spark.createDataFrame([(h, k) for h, k, _, _ in _SPELLINGS], "head string, kind string").distinct()
    fixed = spark.createDataFrame([(f"{h}({a})",) for h, _, a, _ in _SPELLINGS], "name string")
    parts = table(spark, d, "part").where("p_size > 0").select(F.concat(F.lit("weight("), F.col("p_size").cast("string"), F.lit("g.."), F.col("p_size").cast("string"), F.lit("kg)")).alias("name"))
    return valued.canonical_names(fixed.union(parts).distinct(), heads)


def kind_resolution(spark: SparkSession, d: str) -> DataFrame:
    return valued.kinds(_typed_graph(spark, d)[0])


def space_check(spark: SparkSession, d: str) -> DataFrame:
    return valued.spaces(_typed_graph(spark, d)[1])


def virtual_range_price(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["price(1000..50000)"])


def same_head_meet(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["price(..60000)", "price(20000..)", "segment:BUILDING"])


def empty_meet(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["price(..100)", "price(200..)"])


def category_over_range(spark: SparkSession, d: str) -> DataFrame:
    """The category holds a range, which holds prices, which hold orders."""
    return valued.get(*_typed_graph(spark, d), ["bargain"])


def overlap_price(spark: SparkSession, d: str) -> DataFrame:
    return valued.overlapping(*_typed_graph(spark, d), "price(49000..51000)")


def calendar_month(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["time(1995-03)"])


def count_range(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["lines(..2)", "time(1995..1996)"])


def _priced_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges, values): orders under their prices, and also directly under the category of the range that
    holds the price; some are costly although their price is not in the costly range."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("child"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    price = orders.select(F.concat(F.lit("price("), F.col("p").cast("string"), F.lit(")")).alias("parent"), "child")
    direct = orders.where("p <= 50000").select(F.lit("bargain").alias("parent"), "child").unionByName(orders.where("p >= 190000").select(F.lit("costly").alias("parent"), "child"))
    known = [e for e in _TYPED if e[1] in ("dimension", "linear-dimension", "price", "bargain", "costly") or e[1].startswith("price(")]
    return valued.materialised(spark.createDataFrame(known, "parent string, child string"), price.unionByName(direct))


def combined_reduction(spark: SparkSession, d: str) -> DataFrame:
    """The direct edges from categories go where only containment of the price in the category's range implies them."""
    return combined.reduce_edges(*_priced_graph(spark, d))


def typed_union(spark: SparkSession, d: str) -> DataFrame:
    return combined.get_any(*_typed_graph(spark, d), [["price(..5000)"], ["time(1995-03)", "segment:BUILDING"], ["nobody"]])


def typed_refinements(spark: SparkSession, d: str) -> DataFrame:
    """What narrows the customers and orders of a segment right below the prices: the ranges, and the prices outside them."""
    return combined.refinements(*_typed_graph(spark, d), ["segment:BUILDING"], "price")


def typed_entailed(spark: SparkSession, d: str) -> DataFrame:
    """Claims among categories, ranges and orders; between a range and an order only containment makes them."""
    e, vals = _typed_graph(spark, d)
    return combined.entailed(e, vals, q.names(e).where("name LIKE 'order:%' OR name IN ('bargain', 'costly', 'early', 'price(..50000)')"))


def combined_contraction(spark: SparkSession, d: str) -> DataFrame:
    """Prices below 20000 removed: their orders go to the range that held them."""
    e, vals = _priced_graph(spark, d)
    return combined.remove(e, vals, vals.where("v.hi.n < 20000 * v.hi.d AND v.lo <=> v.hi").select("name"))


def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """(band, held): every order's price against a band of ten from each order's price upwards; one group."""
    p = table(spark, d, "orders").select(F.lit(1).alias("g"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("lo"))
    bands = p.withColumn("hi", F.col("lo") + F.lit(10).cast("decimal(18,2)"))
    return ranges.points_in_ranges(p, bands, ["g"], "lo", "lo", "hi").select(F.col("r.o_orderkey").alias("band"), F.col("p.o_orderkey").alias("held"))


def periods_overlap(spark: SparkSession, d: str) -> DataFrame:
    """(early, late): orders of one customer whose periods, from the order to its last receipt, overlap."""
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("hi"))
    o = table(spark, d, "orders").join(last, "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("lo"), "hi")
    met = ranges.overlap_join(o, o, ["o_custkey"]).where("a.o_orderkey < b.o_orderkey")
    return met.select(F.col("a.o_orderkey").alias("one"), F.col("b.o_orderkey").alias("other"))


def periods_within(spark: SparkSession, d: str) -> DataFrame:
    """(outer, inner): orders whose period lies within that of another order of the customer."""
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("hi"))
    o = table(spark, d, "orders").join(last, "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("lo"), "hi")
    met = ranges.containment_join(o, o, ["o_custkey"]).where("r.o_orderkey <> p.o_orderkey")
    return met.select(F.col("r.o_orderkey").alias("outer_order"), F.col("p.o_orderkey").alias("inner_order"))


def value_containment(spark: SparkSession, d: str) -> DataFrame:
    """(term, name): every range, code or tuple of the typed graph, and the ranges from each part's retail
    price to a thousand more, with the values inside."""
    _, vals = _typed_graph(spark, d)
    parts = table(spark, d, "part").select(F.col("p_retailprice").cast("decimal(18,2)").alias("p")).where("p IS NOT NULL").distinct()
    bands = parts.select(F.concat(F.lit("price("), F.col("p").cast("string"), F.lit(".."), (F.col("p") + 100).cast("string"), F.lit(")")).alias("name"))
    asked = bands.select(F.lit("price").alias("head"), T.parsed(F.col("name"), F.lit("linear")).alias("v"))
    outer = vals.where("head IN ('geo', 'time')").select(F.col("name").alias("term"), "head", "v").unionByName(asked.select(F.col("v.canonical").alias("term"), "head", "v"))
    return valued.computed_children(vals, outer)


def dominance_fit(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["box(0.3mx250mmx100mm)"])


def prefix_geo(spark: SparkSession, d: str) -> DataFrame:
    return valued.get(*_typed_graph(spark, d), ["geo(r1)", "segment:BUILDING"])


def value_pairs_below(spark: SparkSession, d: str) -> DataFrame:
    order = F.concat(F.lit("order:"), "o_orderkey")
    sups = F.array(*map(F.lit, ("price(..70000)", "bargain", "early", "time(1994)", "nothing", "price(0..)")))
    return valued.is_below(*_typed_graph(spark, d), table(spark, d, "orders").select(order.alias("sub"), F.explode(sups).alias("sup")).distinct())


def certified_below(spark: SparkSession, d: str) -> DataFrame:
    """Claims about the last order and about prices that need not be present, each proven from the published graph and
    checked against its root alone."""
    book = certificates.publish(*_typed_graph(spark, d))
    last = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    pairs = [("price(10..20)", "bargain"), ("price(10..60000)", "bargain")] + [(f"order:{last}", sup) for sup in ("price(..70000)", "bargain", "early", "nothing")]
    proofs = [certificates.prove(book, *pair) for pair in pairs]
    rows = [(p["sub"], p["sup"], certificates.verify(p, book.root)) for p in proofs]
    return spark.createDataFrame(rows, "sub string, sup string, below boolean")


def answer_count(spark: SparkSession, d: str) -> DataFrame:
    return browse.count(edges(spark, d), browse.disjuncts("region:ASIA segment:BUILDING or nation:NATION_7".split()))


def first_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.page(q.get(edges(spark, d), ["region:ASIA"]), 50)


def browse_position(spark: SparkSession, d: str) -> DataFrame:
    return browse.position(edges(spark, d), ["region:ASIA", "segment:BUILDING"])


def query_log_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return browse.query_log(e.groupBy("user_id", F.to_date("ts")).agg(F.collect_list("event_type").alias("terms")))


def about_store(spark: SparkSession, d: str) -> DataFrame:
    return browse.about(edges(spark, d))


def reachable_counts(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return browse.reachable(e, e.where("parent LIKE 'region:%'").select(F.col("child").alias("term")), _named(e, "order:%"))


def move_note(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    moved = mutation.reclassify(e, e.where("parent = 'segment:BUILDING'").select(F.col("child").alias("name")), ["segment:MACHINERY"], ["segment:BUILDING"])
    return browse.move_note(e, moved, "segment:BUILDING", "segment:MACHINERY")


def query_by_graph(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("*", "region:ASIA"), ("*", "segment:BUILDING"), ("*", "nobody")], "parent string, child string")
    return browse.get_by_graph(edges(spark, d), wanted)


def shared_roots(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return browse.shared(e.where("parent <> 'segment:BUILDING'"), e.where("child NOT LIKE 'region:A%'"))


def node_json(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return browse.node_json(e, canonical.descendant_counts(e))


def overlay_query(spark: SparkSession, d: str) -> DataFrame:
    """Documents under languages in one layer, under quality marks in the other."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    doc = F.concat(F.lit("doc:"), "doc_id")
    one = projection_edges(docs.select(doc.alias("item"), F.array(F.concat(F.lit("sys:lang:"), "lang")).alias("supercategories")))
    two = projection_edges(labels.select(doc.alias("item"), F.array(F.concat(F.lit("sys:quality:"), F.col("quality").cast("string"))).alias("supercategories")))
    return q.get(vocabulary.overlay(one, two), ["sys:lang:en", "sys:quality:1"])


def prelude_heads(spark: SparkSession, d: str) -> DataFrame:
    graph = vocabulary.adopt(edges(spark, d).where("parent = '*'"), vocabulary.prelude(spark))
    brands = table(spark, d, "part").select(F.lit("length").alias("parent"), F.concat(F.lit("brand:"), "p_brand").alias("child")).distinct()
    return valued.kinds(graph.unionByName(brands))  # what hangs below a head is a head of its kind


def _orders_context(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the statuses and priorities of their orders."""
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_custkey").cast("string").alias("obj"), F.explode(F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"))).alias("attr"))


def fca_extent(spark: SparkSession, d: str) -> DataFrame:
    return contexts.extent(_orders_context(spark, d), ["status:F", "priority:1-URGENT"])


def fca_closure(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size <= 2")
    homes = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = homes.select("n_name", F.explode(F.array("r_name", F.concat(F.lit("key:"), F.pmod("n_nationkey", F.lit(5)).cast("string")))).alias("attr"))
    return contexts.closure(rows.select(F.col("n_name").alias("obj"), "attr").union(parts.select("p_name", "p_brand")), ["key:1"])


def fca_density(spark: SparkSession, d: str) -> DataFrame:
    return contexts.density(_orders_context(spark, d))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the market segments in which they have customers in debt."""
    return table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").cast("string").alias("obj"), F.col("c_mktsegment").alias("attr"))


def fca_concepts(spark: SparkSession, d: str) -> DataFrame:
    return contexts.concepts(_nations(spark, d)).select(F.array_join("intent", "|").alias("intent"), "support")


def fca_covers(spark: SparkSession, d: str) -> DataFrame:
    return contexts.covers(contexts.concepts(_nations(spark, d))).select(F.array_join("upper", "|").alias("upper"), F.array_join("lower", "|").alias("lower"))


_SPELLINGS = [
    ("weight", "linear", "0.5g", "1/2000kg"), ("weight", "linear", "1lb", "45359237/100000000kg"), ("weight", "linear", "2kg..2000g", "2kg"), ("wait", "linear", "2min", "120s"), ("length", "linear", "1in..1ft", "127/5000m..381/1250m"),
    ("heat", "linear", "-40C", "4663/20K"), ("number", "linear", "0..5", "..5"), ("count", "count", "2dz", "24"), ("count", "count", "1..5", "..5"), ("size", "dominance", "19x23x39cm", "39/100x23/100x19/100m"),
    ("when", "calendar", "2024-02", "2024-02-01T00:00:00Z..2024-02-29T23:59:59Z"), ("when", "calendar", "..2026", "..2026-12-31T23:59:59Z"), ("place", "prefix", "u4pru", "u4pru"),
]
#: Every set of segments, closed: five attributes, so 32 sets.
_CONCEPTS = """WITH i AS (SELECT DISTINCT c_nationkey AS o, c_mktsegment AS a FROM customer WHERE c_acctbal < -900), t AS (SELECT list(DISTINCT a ORDER BY a) AS every FROM i),
    r AS (SELECT o, list(a ORDER BY a) AS row FROM i GROUP BY o), s AS (SELECT list_filter(every, lambda x, j: (m >> (j - 1)) & 1 = 1) AS b, every FROM t, range(64) g(m) WHERE m < (1 << len(every))),
    k AS (SELECT i, any_value(n) AS support FROM (SELECT b, count(o) AS n, list_filter(any_value(every), lambda x: len(list_filter(list(row) FILTER (WHERE o IS NOT NULL), lambda y: NOT list_contains(y, x))) IS NOT DISTINCT FROM 0 OR count(o) = 0) AS i
        FROM s LEFT JOIN r ON list_has_all(row, b) GROUP BY b) GROUP BY i)"""
_CENTS = "(round(o_totalprice::DECIMAL(18,2) * 100))::BIGINT"
_TAG = f"'price(' || (c // gcd(c, 100)) || CASE WHEN c % 100 = 0 THEN '' ELSE '/' || (100 // gcd(c, 100)) END || ')'"
_T = f"""WITH o AS (SELECT 'order:' || o_orderkey AS name, {_CENTS} AS c, o_orderdate AS day, o_orderkey, o_custkey FROM orders),
    t AS (SELECT *, {_TAG} AS tag, 'time(' || strftime(day, '%Y-%m-%dT00:00:00Z') || '..' || strftime(day, '%Y-%m-%dT23:59:59Z') || ')' AS dtag FROM o)"""


_KNOWN = "SELECT unnest(['*', 'dimension', 'linear-dimension', '*', '*', 'price', 'bargain', 'price', 'costly']) AS parent, unnest(['dimension', 'linear-dimension', 'price', 'bargain', 'costly', 'price(..50000)', 'price(..50000)', 'price(200000..)', 'price(200000..)']) AS child"
_PERIODS = "WITH l AS (SELECT l_orderkey, max(l_shipdate)::DATE AS hi FROM lineitem GROUP BY ALL), o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate::DATE AS lo, hi FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND hi >= o_orderdate::DATE)"
_GEO = "(SELECT DISTINCT 'r' || n_regionkey || 'n' || n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey)"


def _spelled(c: str) -> str:
    """SQL: an amount of cents as a whole number or a fraction in lowest terms."""
    return f"({c} // gcd({c}, 100)) || CASE WHEN {c} % 100 = 0 THEN '' ELSE '/' || (100 // gcd({c}, 100)) END"


def _priced(where: str, more: str = "") -> str:
    return f"{_T} SELECT DISTINCT unnest([tag, name]) AS name FROM t WHERE {where}{more}"


_ANSWER = f"{_cone('c', 'region:ASIA', 'segment:BUILDING')}, x AS (SELECT name FROM c GROUP BY name HAVING count(*) = 2)"
_GONE = f"""{_cone('c', 'region:ASIA', 'segment:BUILDING')}, r AS (SELECT '*' AS name UNION SELECT e.child FROM r JOIN e ON e.parent = r.name WHERE e.child NOT IN ('region:ASIA', 'segment:BUILDING')),
    g AS (SELECT name FROM (SELECT name FROM c UNION SELECT unnest(['region:ASIA', 'segment:BUILDING'])) WHERE name NOT IN (SELECT name FROM r))"""
_RECORD = "SELECT child AS name, sha256(child || chr(10) || to_json(list(parent ORDER BY parent))::VARCHAR) AS hash FROM"

_TWO = """l AS (SELECT * FROM e WHERE child NOT LIKE 'order:%'), r AS (SELECT * FROM e WHERE parent NOT LIKE 'region:%' UNION SELECT 'region:' || r_name, 'cust:' || c_custkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    pl AS (SELECT parent AS a, child AS d FROM l UNION SELECT a, child FROM pl JOIN l ON parent = d), pr AS (SELECT parent AS a, child AS d FROM r UNION SELECT a, child FROM pr JOIN r ON parent = d)"""
_RIGHT = "SELECT parent, child FROM r WHERE (parent, child) NOT IN (SELECT a, d FROM pl) AND NOT (parent = '*' AND child IN (SELECT child FROM l))"
_ONLY = f"""SELECT parent, child, 'left' AS side FROM l WHERE (parent, child) NOT IN (SELECT a, d FROM pr) AND NOT (parent = '*' AND child IN (SELECT child FROM r))
    UNION ALL SELECT parent, child, 'right' FROM ({_RIGHT})"""

SQL = {
    "cone": f"{_EL}, {_cone('c', 'region:ASIA')} SELECT DISTINCT name FROM c",
    "conjunction": f"{_EL}, {_cone('c', 'region:ASIA', 'segment:BUILDING')} SELECT name FROM c GROUP BY name HAVING count(*) = 2",
    "union_of_conjunctions": f"{_E}, {_cone('c', 'region:ASIA', 'segment:BUILDING', 'nation:NATION_7')} SELECT name FROM c GROUP BY name HAVING bool_or(term = 'nation:NATION_7') OR bool_or(term = 'region:ASIA') AND bool_or(term = 'segment:BUILDING')",
    "ancestors": f"{_E}, c AS (SELECT child AS term, parent AS name FROM e WHERE child IN ('order:1', 'order:2') UNION SELECT c.term, e.parent FROM c JOIN e ON e.child = c.name) SELECT term, name FROM c",
    "closure": f"{_E}, {_CLOSURE} SELECT a AS ancestor, d AS descendant FROM p",
    "is_below": f"""{_E}, {_cone('c', 'region:AFRICA', 'region:AMERICA', 'region:ASIA', 'region:EUROPE', 'region:MIDDLE EAST')},
        o AS (SELECT DISTINCT 'order:' || o_orderkey AS sub FROM orders),
        q AS (SELECT sub, unnest(['region:AFRICA', 'region:AMERICA', 'region:ASIA', 'region:EUROPE', 'region:MIDDLE EAST', sub, '*', 'nobody']) AS sup FROM o UNION SELECT 'nobody', 'nobody' UNION SELECT 'region:ASIA', 'region:ASIA')
        SELECT sub, sup, ((sup, sub) IN (SELECT term, name FROM c) OR sup IN (sub, '*') AND sub <> 'nobody') AS below FROM q""",
    "transitive_reduction": f"{_E} SELECT parent, child FROM e",
    "descendant_counts": f"{_E}, {_CLOSURE} SELECT a AS name, count(*) AS n FROM p GROUP BY a UNION ALL SELECT DISTINCT child, 0 FROM e WHERE child NOT IN (SELECT parent FROM e)",
    "refinements": f"{_E}, {_CLOSURE} SELECT a AS term, count(*) AS n FROM p WHERE a IN (SELECT child FROM e WHERE parent = '*') AND d IN (SELECT d FROM p WHERE a = 'segment:BUILDING') GROUP BY a",
    "name_completion": f"{_E} SELECT DISTINCT child AS name FROM e WHERE lower(child) LIKE 'nation:%' ORDER BY 1 LIMIT 40",
    "neighbourhood": f"{_E}, b AS (SELECT parent AS x, child AS y FROM e UNION SELECT child, parent FROM e), n AS (SELECT 'nation:NATION_7' AS name, 0 AS hops UNION SELECT y, hops + 1 FROM n JOIN b ON x = name WHERE hops < 2) SELECT name, min(hops)::INTEGER AS hops FROM n GROUP BY name",
    "compare_graphs": f"{_E}, {_TWO} {_ONLY}",
    "additions_fragment": f"{_E}, {_TWO} {_RIGHT}",
    "cascade_sizes": f"""{_E}, {_TWO}, x AS ({_ONLY}) SELECT 'added' AS side, (SELECT count(*) FROM x WHERE side = 'right') AS edges, (SELECT count(*) FROM (FROM pr EXCEPT FROM pl)) AS claims
        UNION ALL SELECT 'removed', (SELECT count(*) FROM x WHERE side = 'left'), (SELECT count(*) FROM (FROM pl EXCEPT FROM pr))""",
    "entailed_claims": f"{_E}, {_CLOSURE} SELECT a AS sup, d AS sub FROM p WHERE a <> '*' AND a NOT LIKE 'order:%' AND d NOT LIKE 'order:%'",
    "records": f"{_E}, u AS (SELECT child AS name, string_agg(parent, '|' ORDER BY parent) AS up FROM e GROUP BY child), w AS (SELECT parent AS name, string_agg(child, '|' ORDER BY child) AS down FROM e GROUP BY parent) SELECT coalesce(u.name, w.name) AS name, coalesce(up, '') AS up, coalesce(down, '') AS down FROM u FULL JOIN w ON u.name = w.name",
    "interval_containment": "SELECT o_orderkey FROM orders WHERE o_totalprice::DECIMAL(18,2) BETWEEN 1000 AND 50000",
    "calendar_overlap": "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-03-31 23:59:59' AND o_orderdate + INTERVAL 10 DAY >= TIMESTAMP '1995-03-01'",
    "dominance": "SELECT p_partkey FROM part WHERE p_size <= 30 AND 25 >= CASE WHEN p_size <= 20 THEN greatest(p_size, 10) ELSE 20 END AND 10 >= least(p_size, 10)",
    "projection_ingest": "SELECT DISTINCT unnest(['sys:lang:' || lang, 'sys:src:' || source]) AS parent, 'doc:' || doc_id AS child FROM documents",
    "implications": """WITH i AS (SELECT 'cust:' || o_custkey AS obj, 'status:' || o_orderstatus AS attr FROM orders UNION SELECT 'cust:' || o_custkey, 'priority:' || o_orderpriority FROM orders UNION SELECT 'cust:' || c_custkey, unnest(['segment:' || c_mktsegment, 'nation:' || n_name, 'region:' || r_name]) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        s AS (SELECT attr, count(*) AS support FROM i GROUP BY attr)
        SELECT a.attr AS premise, b.attr AS conclusion, any_value(support) AS support FROM i a JOIN i b ON a.obj = b.obj AND a.attr <> b.attr JOIN s ON s.attr = a.attr GROUP BY a.attr, b.attr HAVING count(*) = any_value(support)""",
    "put_batch": f"{_E} SELECT parent, child FROM e UNION SELECT '*', 'wealthy' UNION SELECT 'wealthy', 'cust:' || c_custkey FROM customer WHERE c_acctbal > 5000",
    "contraction": f"{_E} SELECT parent, child FROM e WHERE child LIKE 'region:%' OR child LIKE 'segment:%' UNION SELECT 'region:' || r_name, 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT 'segment:' || c_mktsegment, 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "cone_removal_plan": f"{_E}, {_GONE} SELECT name FROM g",
    "remove_cone": f"{_E}, {_GONE} SELECT parent, child FROM e WHERE parent NOT IN (SELECT name FROM g) AND child NOT IN (SELECT name FROM g)",
    "move": f"{_E} SELECT DISTINCT CASE WHEN parent = 'segment:BUILDING' THEN 'segment:MACHINERY' ELSE parent END AS parent, child FROM e",
    "excerpt": f"{_E}, {_ANSWER}, i AS (SELECT parent, child FROM e WHERE parent IN (SELECT name FROM x) AND child IN (SELECT name FROM x)) SELECT parent, child FROM i UNION SELECT '*', name FROM x WHERE name NOT IN (SELECT child FROM i)",
    "excerpt_with_context": f"{_E}, {_ANSWER}, u AS (SELECT name FROM x UNION SELECT e.parent FROM u JOIN e ON e.child = u.name) SELECT parent, child FROM e WHERE parent IN (SELECT name FROM u) AND child IN (SELECT name FROM u)",
    "copy_below": f"{_E}, {_cone('c', 'region:ASIA', 'nation:NATION_7')}, x AS (SELECT name FROM c UNION SELECT unnest(['region:ASIA', 'nation:NATION_7'])) SELECT parent, child FROM e WHERE parent IN (SELECT name FROM x) AND child IN (SELECT name FROM x)",
    "prune_to_common": f"{_E}, {_ANSWER} SELECT parent, child FROM e WHERE parent IN (SELECT name FROM x) AND child IN (SELECT name FROM x) UNION SELECT '*', unnest(['region:ASIA', 'segment:BUILDING']) UNION SELECT t, name FROM x, (SELECT unnest(['region:ASIA', 'segment:BUILDING']) AS t) WHERE name LIKE 'cust:%'",
    "contested": f"{_E}, {_ANSWER} SELECT name FROM x",
    "focus": f"{_E} SELECT 'above' AS side, parent AS name FROM e WHERE child = 'nation:NATION_7' UNION ALL SELECT 'below', child FROM e WHERE parent = 'nation:NATION_7'",
    "narrowing": f"{_E}, {_ANSWER}, u AS (SELECT name AS m, name AS a FROM x UNION SELECT u.m, e.parent FROM u JOIN e ON e.child = u.a) SELECT a AS term, count(*) AS n FROM u WHERE m <> a AND a NOT IN ('*', 'region:ASIA', 'segment:BUILDING') GROUP BY a HAVING count(*) < (SELECT count(*) FROM x)",
    "cone_index": f"{_E}, {_CLOSURE} SELECT a AS term, d AS name FROM p WHERE a IN (SELECT a FROM p GROUP BY a HAVING count(*) >= 64)",
    "counts_by_delta": f"""{_E}, m AS (SELECT parent, child FROM e WHERE NOT (parent LIKE 'segment:%' AND child IN (SELECT 'cust:' || c_custkey FROM customer WHERE c_acctbal < 0))
        UNION ALL SELECT '*', 'wealthy' UNION ALL SELECT 'wealthy', 'cust:' || c_custkey FROM customer WHERE c_acctbal > 5000),
        p AS (SELECT parent AS a, child AS d FROM m UNION SELECT p.a, m.child FROM p JOIN m ON m.parent = p.d)
        SELECT a AS name, count(*) AS n FROM p GROUP BY a UNION ALL SELECT DISTINCT child, 0 FROM m WHERE child NOT IN (SELECT parent FROM m)""",
    "diff_by_groups": "SELECT 'cust:' || c_custkey AS name, 'changed' AS change FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'added', 'added'",
    "dominance_pairs": """WITH b AS (SELECT n_name AS nation, list_sort([n_nationkey, n_nationkey * 2, 12]) AS s FROM nation), p AS (SELECT p_partkey AS part, list_sort([p_size, 20, 10]) AS t FROM part WHERE p_size IS NOT NULL)
        SELECT nation, part FROM b JOIN p ON t[1] <= s[1] AND t[2] <= s[2] AND t[3] <= s[3]""",
    "cones_from_index": f"{_E}, {_cone('c', *_INDEXED)} SELECT unnest(['index', 'walk']) AS way, term, name FROM c",
    "walk_or_probe": f"{_E}, {_cone('c', 'segment:BUILDING', 'nation:NATION_7')} SELECT name FROM c GROUP BY name HAVING count(*) = 2",
    "optimised_put": f"""{_E}, i AS (SELECT 'new:' || n_name AS item, unnest(['nation:' || n_name, 'segment:BUILDING']) AS name FROM nation),
        h AS (SELECT item, name FROM i UNION SELECT item, e.parent FROM h JOIN e ON e.child = h.name WHERE e.parent <> '*'),
        j AS (SELECT DISTINCT item FROM i),
        o AS (SELECT item, e.child AS name FROM j JOIN e ON e.parent = '*' ANTI JOIN h ON h.item = j.item AND h.name = e.child
            UNION SELECT o.item, e.child FROM o JOIN e ON e.parent = o.name WHERE (o.item, e.child) NOT IN (SELECT item, name FROM h)),
        x AS (SELECT item, name AS parent FROM j, (SELECT DISTINCT child AS name FROM e WHERE child NOT IN (SELECT parent FROM e)) l WHERE (item, name) NOT IN (SELECT item, name FROM o))
        FROM x UNION ALL SELECT item, '*' FROM j WHERE item NOT IN (SELECT item FROM x)""",
    "sql_functions": """WITH c AS (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
        SELECT r_name AS region, n AS customers, true AS first_below, 'key(' || r_regionkey || '..)' AS spelled, r_regionkey >= 2 AS held FROM region JOIN c ON k = r_regionkey""",
    "topological_order": f"""{_E}, p AS (SELECT name, [name] AS path FROM (SELECT parent AS name FROM e UNION SELECT child FROM e) UNION ALL SELECT e.child, list_append(p.path, e.child) FROM p JOIN e ON e.parent = p.name)
        SELECT name, row_number() OVER (ORDER BY max(path)) - 1 AS place FROM p GROUP BY name""",
    "ancestors_around": f"""{_E}, o AS (SELECT parent, child FROM e WHERE parent NOT LIKE 'nation:%'), c AS (SELECT o.child AS term, o.parent AS name FROM o WHERE child IN (SELECT 'cust:' || c_custkey FROM customer WHERE c_acctbal < 0)
        UNION SELECT c.term, o.parent FROM c JOIN o ON o.child = c.name) SELECT term, name FROM c""",
    "merge_preview": """WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT 'item' AS part, 'city:' || n_name AS name, 'nation:' || n_name AS other FROM n UNION ALL SELECT DISTINCT 'item', 'market', '*' FROM n WHERE r_name = 'ASIA'
        UNION ALL SELECT unnest(['claim', 'unrelated']), 'nation:' || n_name, 'market' FROM n WHERE r_name = 'ASIA'
        UNION ALL SELECT 'item', 'unit(u' || n_nationkey || '=' || (n_regionkey + 1) || 'kg)', 'unit-declaration' FROM n WHERE n_regionkey <> n_nationkey
        UNION ALL SELECT 'conflict', 'u' || n_nationkey, 'unit u' || n_nationkey || ' is defined twice' FROM n WHERE n_regionkey <> n_nationkey""",
    "checked_move": f"""{_E}, h AS (SELECT parent, child FROM e WHERE child NOT LIKE 'order:%'), m AS (SELECT child FROM h WHERE parent = 'segment:BUILDING')
        SELECT 'edge' AS part, parent, child FROM h WHERE parent <> 'segment:BUILDING' UNION ALL SELECT 'edge', unnest(['segment:MACHINERY', 'price(10..20)']), child FROM m
        UNION ALL SELECT 'edge', unnest(['*', 'linear-dimension', 'price']), unnest(['linear-dimension', 'price', 'price(10..20)']) UNION ALL SELECT 'retracted', 'segment:BUILDING', child FROM m""",
    "topological_levels": f"{_EL}, l AS (SELECT '*' AS name, 0 AS level UNION SELECT e.child, level + 1 FROM l JOIN e ON e.parent = l.name) SELECT name, max(level)::BIGINT AS level FROM l WHERE name <> '*' GROUP BY name",
    "ancestor_codes": f"{_E}, {_CLOSURE} SELECT d AS name, string_agg(a, '|' ORDER BY a) AS code FROM (SELECT a, d FROM p UNION SELECT d, d FROM p) GROUP BY d",
    "code_round_trip": f"{_E} SELECT parent, child FROM e",
    "record_hashes": f"{_E} {_RECORD} e GROUP BY child",
    "changed_records": f"{_E}, a AS ({_RECORD} e WHERE parent <> 'segment:BUILDING' GROUP BY child), b AS ({_RECORD} e WHERE child NOT LIKE 'nation:%' GROUP BY child) SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash",
    "reclassified": f"{_E}, {_cone('c', 'segment:BUILDING')} SELECT DISTINCT name FROM c",
    "provenance_standing": "WITH t AS (SELECT event_type AS subject, user_id, bool_or(event_type = 'refund') AS back FROM events WHERE user_id IN (1, 2, 3) GROUP BY ALL) SELECT subject, coalesce(bool_or(NOT back), false) AS accepted FROM (SELECT DISTINCT event_type AS subject FROM events) LEFT JOIN t USING (subject) GROUP BY subject",
    "provenance_acts": "SELECT 'user:' || user_id AS sub, 'did:' || event_type AS sup, CASE WHEN event_id % 3 = 0 THEN 'endorse' ELSE 'assert' END AS act, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
    "owl_lines": f"""{_E} SELECT child AS name, '<owl:Class rdf:about="#' || child || '">' || coalesce(string_agg('<rdfs:subClassOf rdf:resource="#' || parent || '"/>', '' ORDER BY parent) FILTER (WHERE parent <> '*'), '') || '</owl:Class>' AS element FROM e GROUP BY child""",
    "manchester": f"{_E} SELECT child AS name, 'Class: <' || child || '>' || coalesce(chr(10) || '    SubClassOf: ' || string_agg('<' || parent || '>', ', ' ORDER BY parent) FILTER (WHERE parent <> '*'), '') AS frame FROM e GROUP BY child",
    "answer_count": f"{_E}, {_cone('c', 'region:ASIA', 'segment:BUILDING', 'nation:NATION_7')} SELECT count(*) AS n FROM (SELECT name FROM c GROUP BY name HAVING bool_or(term = 'nation:NATION_7') OR bool_or(term = 'region:ASIA') AND bool_or(term = 'segment:BUILDING'))",
    "first_page": f"{_E}, {_cone('c', 'region:ASIA')}, x AS (SELECT DISTINCT name FROM c) SELECT name, (SELECT count(*) FROM x) AS count, (SELECT count(*) FROM x) > 50 AS truncated FROM x ORDER BY name LIMIT 50",
    "browse_position": f"""{_E}, {_ANSWER}, u AS (SELECT name AS m, name AS a FROM x UNION SELECT u.m, e.parent FROM u JOIN e ON e.child = u.a) SELECT 'here' AS kind, name, 0 AS n FROM x
        UNION ALL SELECT 'refine', a, count(*) FROM u WHERE m <> a AND a NOT IN ('*', 'region:ASIA', 'segment:BUILDING') GROUP BY a HAVING count(*) < (SELECT count(*) FROM x) UNION ALL SELECT 'count', '', count(*) FROM x""",
    "query_log_counts": "SELECT query, count(*) AS n FROM (SELECT string_agg(t, ' ' ORDER BY t) AS query FROM (SELECT DISTINCT user_id, ts::DATE AS day, event_type AS t FROM events) GROUP BY user_id, day) GROUP BY query",
    "about_store": f"{_E} SELECT 'names' AS what, count(DISTINCT child) AS n FROM e UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'top', count(*) FROM e WHERE parent = '*' UNION ALL SELECT 'leaves', count(DISTINCT child) FROM e WHERE child NOT IN (SELECT parent FROM e)",
    "reachable_counts": f"{_E}, {_CLOSURE} SELECT t.child AS term, count(p.d) AS n FROM (SELECT child FROM e WHERE parent LIKE 'region:%') t LEFT JOIN p ON p.a = t.child AND p.d LIKE 'order:%' GROUP BY t.child",
    "move_note": f"{_E}, {_cone('c', 'segment:BUILDING')} SELECT unnest(['departed', 'arrived', 'contested']) AS what, unnest([(SELECT count(DISTINCT name) FROM c), (SELECT count(DISTINCT name) FROM c), 0]) AS n",
    "query_by_graph": f"{_E}, {_ANSWER} SELECT name FROM x",
    "shared_roots": f"{_E} SELECT parent, child FROM e WHERE parent = '*' AND child NOT LIKE 'region:A%'",
    "node_json": f"""{_E}, {_CLOSURE}, n AS (SELECT a, count(*) AS n FROM p GROUP BY a), u AS (SELECT child, to_json(list(parent ORDER BY parent))::VARCHAR AS up FROM e GROUP BY child)
        SELECT child AS name, '{{"name":' || to_json(child)::VARCHAR || ',"parents":' || up || ',"descendant_count":' || coalesce(n, 0) || '}}' AS json FROM u LEFT JOIN n ON a = child""",
    "overlay_query": "SELECT DISTINCT 'doc:' || d.doc_id AS name FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE lang = 'en' AND quality = 1",
    "prelude_heads": "SELECT unnest(['weight', 'length', 'duration', 'area', 'volume', 'speed', 'pressure', 'temperature', 'energy']) AS head, 'linear' AS kind UNION ALL FROM (VALUES ('count', 'count'), ('time', 'calendar'), ('geo', 'prefix'), ('size', 'dominance')) UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'linear' FROM part WHERE p_brand IS NOT NULL",
    "fca_extent": "SELECT o_custkey::VARCHAR AS obj FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderpriority = '1-URGENT')",
    "fca_closure": "WITH i AS (SELECT n_name AS obj, unnest([r_name, 'key:' || (n_nationkey % 5)]) AS attr FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT obj FROM i WHERE attr = 'key:1') SELECT attr FROM (SELECT DISTINCT * FROM i) WHERE obj IN (FROM x) GROUP BY attr HAVING count(*) = (SELECT count(DISTINCT obj) FROM x)",
    "fca_density": "WITH i AS (SELECT DISTINCT o_custkey, unnest(['status:' || o_orderstatus, 'priority:' || o_orderpriority]) AS a FROM orders) SELECT count(DISTINCT o_custkey) AS objects, count(DISTINCT a) AS attributes, count(*) AS pairs, round(count(*) / (count(DISTINCT o_custkey) * count(DISTINCT a)), 6) AS density FROM i",
    "fca_concepts": f"{_CONCEPTS} SELECT array_to_string(i, '|') AS intent, support FROM k",
    "fca_covers": f"""{_CONCEPTS} SELECT array_to_string(a.i, '|') AS upper, array_to_string(b.i, '|') AS lower FROM k a JOIN k b ON len(a.i) < len(b.i) AND list_has_all(b.i, a.i)
        WHERE NOT EXISTS (SELECT 1 FROM k c WHERE len(a.i) < len(c.i) AND len(c.i) < len(b.i) AND list_has_all(c.i, a.i) AND list_has_all(b.i, c.i))""",
    "canonical_units": "SELECT name, canonical FROM (VALUES " + ", ".join(f"('{h}({a})', '{h}({b})')" for h, _, a, b in _SPELLINGS) + """) v(name, canonical)
        UNION SELECT 'weight(' || p_size || 'g..' || p_size || 'kg)', 'weight(' || (p_size // gcd(p_size, 1000)) || CASE WHEN p_size % 1000 = 0 THEN '' ELSE '/' || (1000 // gcd(p_size, 1000)) END || 'kg..' || p_size || 'kg)' FROM part WHERE p_size > 0""",
    "kind_resolution": "SELECT head, kind FROM (VALUES ('price', 'linear'), ('time', 'calendar'), ('lines', 'count'), ('box', 'dominance'), ('geo', 'prefix')) v(head, kind)",
    "space_check": "SELECT head, spaces, true AS sound FROM (VALUES ('price', 'linear:count'), ('time', 'linear:time'), ('lines', 'linear:count'), ('box', 'dominance:length:3'), ('geo', 'prefix')) v(head, spaces)",
    "virtual_range_price": _priced("c BETWEEN 100000 AND 5000000"),
    "same_head_meet": f"{_T} SELECT DISTINCT name FROM t JOIN customer ON o_custkey = c_custkey WHERE c BETWEEN 2000000 AND 6000000 AND c_mktsegment = 'BUILDING'",
    "empty_meet": "SELECT 'x' AS name WHERE false",
    "category_over_range": _priced("c <= 5000000", " UNION SELECT 'price(..50000)'"),
    "overlap_price": _priced("c BETWEEN 4900000 AND 5100000", " UNION SELECT 'price(..50000)'"),
    "combined_reduction": f"""{_T}, k AS ({_KNOWN}) FROM k UNION SELECT 'price', tag FROM t UNION SELECT tag, name FROM t UNION SELECT 'costly', name FROM t WHERE c >= 19000000 AND c < 20000000""",
    "combined_contraction": f"""{_T}, k AS ({_KNOWN}) FROM k UNION SELECT 'price', tag FROM t WHERE c >= 2000000 UNION SELECT tag, name FROM t WHERE c >= 2000000
        UNION SELECT 'price(..50000)', name FROM t WHERE c < 2000000 UNION SELECT 'costly', name FROM t WHERE c >= 19000000 AND c < 20000000""",
    "typed_union": f"""{_T} SELECT DISTINCT unnest([tag, name]) AS name FROM t WHERE c <= 500000
        UNION SELECT name FROM t JOIN customer ON o_custkey = c_custkey WHERE strftime(day, '%Y-%m') = '1995-03' AND c_mktsegment = 'BUILDING'""",
    "typed_refinements": f"""{_T}, b AS (SELECT c, tag FROM t JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
        SELECT term, n FROM (SELECT 'price(..50000)' AS term, count(*) AS n FROM b WHERE c <= 5000000 UNION ALL SELECT 'price(200000..)', count(*) FROM b WHERE c >= 20000000
            UNION ALL SELECT tag, count(*) FROM b WHERE c > 5000000 AND c < 20000000 GROUP BY tag) WHERE n > 0""",
    "typed_entailed": f"""{_T} SELECT unnest(['bargain', 'price(..50000)']) AS sup, name AS sub FROM t WHERE c <= 5000000 UNION ALL SELECT 'costly', name FROM t WHERE c >= 20000000
        UNION ALL SELECT 'early', name FROM t WHERE year(day) <= 1993 UNION ALL SELECT 'bargain', 'price(..50000)'""",
    "price_bands": "WITH o AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS p FROM orders) SELECT a.o_orderkey AS band, b.o_orderkey AS held FROM o a JOIN o b ON b.p >= a.p AND b.p <= a.p + 10",
    "periods_overlap": f"{_PERIODS} SELECT a.k AS one, b.k AS other FROM o a JOIN o b ON a.c = b.c AND a.k < b.k AND a.lo <= b.hi AND b.lo <= a.hi",
    "periods_within": f"{_PERIODS} SELECT a.k AS outer_order, b.k AS inner_order FROM o a JOIN o b ON a.c = b.c AND a.k <> b.k AND a.lo <= b.lo AND b.hi <= a.hi",
    "value_containment": f"""{_T}, b AS (SELECT DISTINCT (p_retailprice::DECIMAL(18,2) * 100)::BIGINT AS x FROM part WHERE p_retailprice IS NOT NULL),
        n AS (SELECT DISTINCT c, tag FROM t), s AS (SELECT x, {_spelled("x")} AS lo, {_spelled("(x + 10000)")} AS hi FROM b)
        SELECT 'price(' || lo || '..' || hi || ')' AS term, tag AS name FROM s JOIN n ON c BETWEEN x AND x + 10000
        UNION ALL SELECT DISTINCT 'time(..1993-12-31T23:59:59Z)', dtag FROM t WHERE year(day) <= 1993
        UNION ALL SELECT 'geo(' || a || ')', 'geo(' || b || ')' FROM {_GEO} x(a), {_GEO} y(b) WHERE a <> b AND starts_with(b, a)""",
    "calendar_month": f"{_T} SELECT DISTINCT unnest([dtag, name]) AS name FROM t WHERE strftime(day, '%Y-%m') = '1995-03'",
    "count_range": f"{_T} SELECT DISTINCT name FROM t JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE n <= 2 AND year(day) IN (1995, 1996)",
    "dominance_fit": """WITH p AS (SELECT p_partkey, list_sort([p_size, 20, 10], 'DESC') AS b FROM part WHERE p_size IS NOT NULL),
        f AS (SELECT *, 'box(' || list_aggregate(list_transform(b, lambda x: (x // gcd(x, 100)) || CASE WHEN x % 100 = 0 THEN '' ELSE '/' || (100 // gcd(x, 100)) END), 'string_agg', 'x') || 'm)' AS tag FROM p)
        SELECT DISTINCT unnest([tag, 'part:' || p_partkey]) AS name FROM f WHERE b[1] <= 30 AND b[2] <= 25 AND b[3] <= 10""",
    "prefix_geo": """SELECT 'cust:' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'
        UNION SELECT 'order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING'""",
    "value_pairs_below": f"""{_T} SELECT DISTINCT name AS sub, unnest(['price(..70000)', 'bargain', 'early', 'time(1994)', 'nothing', 'price(0..)']) AS sup,
        unnest([c <= 7000000, c <= 5000000, year(day) <= 1993, year(day) = 1994, false, true]) AS below FROM t""",
    "certified_below": f"""{_T} SELECT 'order:' || o_orderkey AS sub, unnest(['price(..70000)', 'bargain', 'early', 'nothing']) AS sup, unnest([c <= 7000000, c <= 5000000, year(day) <= 1993, false]) AS below
        FROM t WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'price(10..20)', 'bargain', true UNION ALL SELECT 'price(10..60000)', 'bargain', false""",
    "dot_lines": f"""{_E} SELECT '"' || child || '" -> "' || parent || '";' AS value FROM e""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
