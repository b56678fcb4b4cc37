"""Readers and writers of graph texts: projection JSON lines, and the native line format."""

from __future__ import annotations

import json
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import merge, reduce_edges
from ..operators.traversal import topological_order
from ..session import materialize

PROJECTION = "item string, supercategories array<string>"


def projection_edges(rows: DataFrame) -> DataFrame:
    """(parent, child) of projection rows; an item without categories is under the root."""
    under = F.when(F.size(F.coalesce("supercategories", F.array().cast("array<string>"))) > 0, F.col("supercategories")).otherwise(F.array(F.lit("*")))
    return rows.where("item is not null").select(F.explode(under).alias("parent"), F.col("item").alias("child")).where("parent is not null").distinct()


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON-lines projection; lines that do not parse stop the read."""
    return projection_edges(spark.read.schema(PROJECTION).option("mode", "FAILFAST").json(path))


def _native_lines(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, meta) of a native text: an edge, or a name's metadata as JSON with a null parent.
    A line that does not parse stops the read with its file and its number there."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                for number, line in enumerate(text.split("\n"), 1):
                    try:
                        if line.startswith("#:meta "):
                            name, _, body = line[7:].partition(" ") if line[7] != "'" else (shlex.split(line[7:])[0], "", line[line.index("{") :])
                            rows.append((None, name, json.dumps(json.loads(body), sort_keys=True)))
                        elif line.strip() and not line.lstrip().startswith("#"):
                            name, *up = shlex.split(line)
                            rows += [(p, name, None) for p in up or ["*"]]
                    except ValueError as e:
                        raise ValueError(f"{path}, line {number}: {e}") from None
            yield pd.DataFrame(rows, columns=["parent", "child", "meta"])

    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())  # a part file at a time, for line numbers
    return whole.mapInPandas(parse, "parent string, child string, meta string")


def read_native(spark: SparkSession, path: str, reduced: bool = False) -> DataFrame:
    """Edges of a native text: `name parent...` a line, shell-quoted; `#` begins a comment line.
    reduced: in canonical form, whatever the text said twice."""
    found = _native_lines(spark, path).where("parent IS NOT NULL").select("parent", "child").distinct()
    return reduce_edges(materialize(found)) if reduced else found


def read_native_meta(spark: SparkSession, path: str) -> DataFrame:
    """(name, meta) of the `#:meta NAME JSON` lines of a native text, keys sorted."""
    return _native_lines(spark, path).where("parent IS NULL").select(F.col("child").alias("name"), "meta").distinct()


def write_native(edges: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """One line a name with its sorted parents, sorted by name over all part files, each name's metadata
    (name, meta: JSON), if given, on the line after it."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    lines = edges.groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("up"))
    text = F.array_join(F.concat(F.array(quote(F.col("child"))), F.transform(F.filter("up", lambda p: p != "*"), quote)), " ")
    rows = lines.select("child", F.lit(0).alias("i"), text.alias("value"))
    if meta is not None:
        rows = rows.union(meta.select(F.col("name").alias("child"), F.lit(1).alias("i"), F.concat(F.lit("#:meta "), quote(F.col("name")), F.lit(" "), "meta")))
    rows.orderBy("child", "i").select("value").write.text(path)


def merge_meta(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, meta) of both, maps of strings: a key that both have keeps our value."""
    both = ours.withColumnRenamed("meta", "a").join(theirs.withColumnRenamed("meta", "b"), "name", "full")
    none = F.create_map().cast("map<string,string>")
    ours_, theirs_ = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("name", F.map_concat(F.map_filter(theirs_, lambda k, _: ~F.map_contains_key(ours_, k)), ours_).alias("meta"))


def merge_payloads(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, payload) of both; ours where both have one."""
    return ours.join(theirs.withColumnRenamed("payload", "b"), "name", "full").select("name", F.coalesce("payload", "b").alias("payload"))


def read_manchester(spark: SparkSession, path: str, context: DataFrame | None = None) -> DataFrame:
    """Edges of the class frames of a Manchester text. Names are `<name>` or `:name`; `owl:Thing` is no parent. A
    parent that no frame defines counts only if it is in `context` (parent, child); a class without a
    parent that counts is under the root."""
    frames = spark.read.text(path, lineSep="Class: ").where("value LIKE '<%' OR value LIKE ':%'")
    listed = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*SubClassOf:([^\n]*(?:,\s*\n[^\n]*)*)"), F.lit(1)), ",")
    name = r"<([^>]*)>|(?<!\w):([^\s,]+)"
    local = lambda c: F.regexp_replace(c, "^<|>$|^:", "")
    ups = F.transform(F.regexp_extract_all(listed, F.lit(name), F.lit(0)), local)
    found = materialize(projection_edges(frames.select(local(F.regexp_extract("value", name, 0)).alias("item"), ups.alias("supercategories"))).where("child <> '*'"))
    known = found.select(F.col("child").alias("parent")).union(spark.createDataFrame([("*",)], "parent string"))
    if context is not None:
        known = known.union(context.select("parent")).union(context.select("child"))
    kept = found.join(known.distinct(), "parent", "left_semi").select("parent", "child")
    loose = found.select("child").distinct().join(kept, "child", "left_anti")
    both = kept.unionByName(loose.select(F.lit("*").alias("parent"), "child"))
    placed = both.where("parent <> '*'").select("child").distinct()
    return both.where("parent <> '*'").unionByName(both.where("parent = '*'").join(placed, "child", "left_anti").select("parent", "child"))


def merge_manchester(edges: DataFrame, path: str) -> DataFrame:
    """`edges` with a Manchester text merged in, whose parents may be names of `edges` alone."""
    return merge(edges, read_manchester(edges.sparkSession, path, edges))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a file by its ending: .od native, .owl, .omn, .jsonl a projection."""
    readers = {"od": read_native, "owl": read_owl_classes, "omn": read_manchester, "jsonl": read_projection}
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending not in readers:
        raise ValueError(f"no reader for {path!r}; endings are {', '.join(sorted(readers))}")
    return readers[ending](spark, path)


def owl_classes(edges: DataFrame) -> DataFrame:
    """(name, element): an OWL class element for every name; refuses names with a quote."""
    safe = lambda c: F.when(c.contains('"'), F.raise_error(F.concat(F.lit("not an IRI: "), c))).otherwise(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    up = edges.groupBy(F.col("child").alias("name")).agg(F.array_sort(F.collect_set("parent")).alias("up"))
    inside = F.transform(F.filter("up", lambda p: p != "*"), lambda p: F.concat(F.lit('<rdfs:subClassOf rdf:resource="#'), safe(p), F.lit('"/>')))
    return up.select("name", F.concat(F.lit('<owl:Class rdf:about="#'), safe(F.col("name")), F.lit('">'), F.array_join(inside, ""), F.lit("</owl:Class>")).alias("element"))


def _in_order(edges: DataFrame, lines: DataFrame, first: str, last: str) -> DataFrame:
    """(value): the lines (name, value) in topological order between a first and a last one; written, its part files
    read one after the other are the text."""
    ends = edges.sparkSession.createDataFrame([(0, -1, first), (2, -1, last)], "i int, place long, value string")
    body = lines.join(topological_order(edges), "name").select(F.lit(1).alias("i"), "place", "value")
    return ends.union(body).where("value <> ''").orderBy("i", "place").select("value")


def write_owl(edges: DataFrame, path: str) -> None:
    """One OWL RDF/XML document in topological order, in part files that follow each other."""
    head = '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    _in_order(edges, owl_classes(edges).withColumnRenamed("element", "value"), head, "</rdf:RDF>").write.text(path)


def write_manchester(edges: DataFrame, path: str) -> None:
    """A Manchester text of the class frames in topological order, in part files that follow each other."""
    _in_order(edges, manchester_frames(edges).withColumnRenamed("frame", "value"), "Ontology:", "").write.text(path)


def manchester_frames(edges: DataFrame) -> DataFrame:
    """(name, frame): a class frame of the Manchester syntax for every name; refuses names with a quote."""
    iri = lambda c: F.concat(F.lit("<"), F.when(c.contains('"'), F.raise_error(F.concat(F.lit("not an IRI: "), c))).otherwise(c), F.lit(">"))
    up = edges.groupBy(F.col("child").alias("name")).agg(F.array_sort(F.collect_set("parent")).alias("up"))
    listed = F.filter("up", lambda p: p != "*")
    body = F.when(F.size(listed) > 0, F.concat(F.lit("\n    SubClassOf: "), F.array_join(F.transform(listed, iri), ", "))).otherwise("")
    return up.select("name", F.concat(F.lit("Class: "), iri(F.col("name")), body).alias("frame"))


def read_owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the classes of an OWL RDF/XML file; a class without a named superclass is under the root."""
    about = "_rdf:about string, `rdfs:subClassOf` array<struct<`_rdf:resource`: string, `_VALUE`: string>>"
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(about.replace("_rdf:about", "`_rdf:about`")).load(path)
    local = lambda c: F.regexp_extract(c, "([^#]*)$", 1)
    ups = F.filter(F.transform(F.coalesce("`rdfs:subClassOf`", F.array()), lambda x: x["_rdf:resource"]), lambda x: x.isNotNull())
    return projection_edges(rows.select(local(F.col("`_rdf:about`")).alias("item"), F.transform(ups, local).alias("supercategories")))


def dot(edges: DataFrame) -> DataFrame:
    """(value): the lines of a DOT drawing of the graph, without its braces."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quote(F.col("child")), F.lit(" -> "), quote(F.col("parent")), F.lit(";")).alias("value"))
