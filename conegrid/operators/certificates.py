"""Certificates that one term is, or is not, below another in the combined order of a published graph.

A publication is a tree of digests over entries (key, body): a name's parents, and each head's star, its
values that can hold others. Entries are dealt by the digest of their key into leaves of about sixteen, and each node
above has at most sixteen children, so a path shows in a few lines that an entry is there, or that none is. Stars
are sorted and cut into blocks of `BLOCK` values under nodes that give their blocks' bounds, so "no other value of this head
holds that one" takes a few nodes and not the star. The root commits to all of it.

A certificate carries the entries that the question touches and their paths. Whoever has only the root runs the same
search on it: an entry that is missing, changed or left out of a star stops the check (ValueError). Units that a graph declares
itself are no part of a publication; both sides name them. Terms may be virtual; unknown names are below nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.units import UNITS, Units
from ..session import materialize
from .ranges import BLOCK, _ranked
from .valued import KIND_NODES, _wide

#: Bounds of open ends; doubles that JSON can hold.
_FAR = 1e300
#: Entries of a leaf, on average, at most, by an estimate of their number.
_LEAF = 16
#: Gives the bodies of keys that are there.
Read = Callable[[list[str]], dict[str, str]]


class Publication(NamedTuple):
    leaves: DataFrame  # prefix, entries (key, body), digest
    nodes: DataFrame  # prefix, lines: what is above the leaves
    depth: int
    levels: int
    root: str


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _root(depth: int, levels: int, top: str) -> str:
    return _digest(f"{depth}/{levels}/{top}")


def _stars(vals: DataFrame) -> tuple[list[DataFrame], int]:
    """(key, body) of each level of the stars, and the number of the highest level."""
    ratio = lambda x: x["n"].cast("double") / x["d"].cast("double")
    least = F.when(F.col("v.parts").isNull(), ratio(F.col("v.lo")))
    most = F.coalesce(ratio(F.col("v.hi")), ratio(F.get("v.parts", F.lit(0))))
    wide = vals.where(_wide("v")).select(
        "head", "name", F.coalesce(least - F.abs(least) * 1e-9, F.lit(-_FAR)).alias("lo"), F.coalesce(most + F.abs(most) * 1e-9, F.lit(_FAR)).alias("hi"), F.col("v.code").alias("a"))
    points = wide.select("head", F.struct("lo", "a", "name").alias("at"), F.struct("*").alias("p"))
    none = points.select("head", F.col("at").alias("lo"), F.col("at").alias("hi"), F.lit(0).cast("long").alias("_id")).where("false")
    ranked, _ = _ranked(points, none, ["head"], False)  # names differ, so the order is the same whatever the layout
    bounds = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("a").alias("a"), F.max("z").alias("z")]
    at = ranked.select(F.floor(F.col("_rank") / BLOCK).alias("i"), "p.*", F.col("p.a").alias("z"))
    at = materialize(at.groupBy("head", "i").agg(F.array_sort(F.collect_list("name")).alias("held"), *bounds))
    out, level = [], 0
    while True:
        out.append(at.select(F.concat_ws("\n", F.lit("s"), "head", F.lit(str(level)), "i").alias("key"), F.to_json("held").alias("body")))
        if not at.agg(F.max("i")).first()[0]:
            return out, level
        kids = F.array_sort(F.collect_list(F.struct("i", "lo", "hi", "a", "z"))).alias("held")
        at, level = materialize(at.groupBy("head", F.floor(F.col("i") / BLOCK).alias("up")).agg(kids, *bounds).withColumnRenamed("up", "i")), level + 1


def publish(edges: DataFrame, vals: DataFrame) -> Publication:
    """The entries of a graph and the tree over them; equal graphs have equal roots whatever their layout.

    Edges are shuffled once, to the leaf of their child; a leaf's lines follow from its entries and are stored nowhere."""
    stars, levels = _stars(vals)
    none = F.lit(None).cast("string")
    rows = edges.select(F.concat(F.lit("n\n"), "child").alias("key"), "parent", none.alias("body"))
    for star in stars:
        rows = rows.unionByName(star.select("key", none.alias("parent"), "body"))
    n, depth = rows.agg(F.approx_count_distinct("key", 0.01)).first()[0], 0  # an estimate that only the keys decide
    while _LEAF * 16**depth < n:
        depth += 1
    # dealt by prefix, so entries and leaves are made where the rows lie, and a lookup reads the row groups that can hold its leaf
    dealt = rows.withColumn("prefix", F.substring(F.sha2("key", 256), 1, depth)).repartitionByRange("prefix")
    made = dealt.groupBy("prefix", "key").agg(F.array_sort(F.collect_set("parent")).alias("up"), F.max("body").alias("body"))
    entry = F.struct("key", F.coalesce("body", F.to_json("up")).alias("body"))
    held = made.groupBy("prefix").agg(F.array_sort(F.collect_list(entry)).alias("entries")).sortWithinPartitions("prefix")
    leaves = materialize(held.withColumn("digest", F.sha2(F.array_join(_lines("entries"), "\n"), 256)))
    below, nodes = leaves.select("prefix", "digest"), edges.sparkSession.createDataFrame([], "prefix string, lines array<string>")
    for length in range(depth - 1, -1, -1):
        line = F.concat("prefix", F.lit(":"), "digest")
        level = materialize(below.groupBy(F.substring("prefix", 1, length).alias("up")).agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumnRenamed("up", "prefix"))
        nodes = nodes.unionByName(level)
        below = level.select("prefix", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))
    top = below.select("digest").first()
    nodes = materialize(nodes.repartitionByRange("prefix").sortWithinPartitions("prefix"))
    return Publication(leaves, nodes, depth, levels, _root(depth, levels, top[0] if top else ""))


def _lines(entries: str) -> Column:
    """The lines of a leaf: each entry's digests of key and body, sorted."""
    return F.array_sort(F.transform(entries, lambda e: F.concat(F.sha2(e["key"], 256), F.lit(":"), F.sha2(e["body"], 256))))


class _Search:
    """One question, asked of whatever `read` gives; the reads of a round go together."""

    def __init__(self, read: Read, levels: int, units: Units):
        self.read, self.levels, self.units = read, levels, units
        self.up: dict[str, list[str] | None] = {}
        self.kind: dict[str, str | None] = {}

    def parents(self, names: set[str]) -> None:
        new = sorted(names - self.up.keys())
        got = self.read([f"n\n{n}" for n in new]) if new else {}
        self.up |= {n: json.loads(got[f"n\n{n}"]) if f"n\n{n}" in got else None for n in new}

    def kinds(self, names: set[str]) -> None:
        """Learn the kinds of the names' heads, from the plain names above them."""
        heads = {s[0] for n in names if (s := T.split_term(n))} - self.kind.keys()
        above, front = {h: {h} for h in heads}, {h: {h} for h in heads}
        while any(front.values()):
            self.parents(set().union(*front.values()))
            for h, at in front.items():
                front[h] = {p for n in at for p in self.up[n] or () if not T.split_term(p)} - above[h]
                above[h] |= front[h]
        for h in heads:
            found = (above[h] - {h}) & KIND_NODES.keys()
            self.kind[h] = KIND_NODES[found.pop()] if len(found) == 1 else None

    def value(self, name: str) -> tuple[str, T.Value] | None:
        split = T.split_term(name)
        try:
            return (split[0], T.read(split[1], self.kind[split[0]], self.units)) if split and self.kind.get(split[0]) else None
        except ValueError:
            return None

    def spelled(self, name: str) -> str:
        v = self.value(name)
        return f"{v[0]}({T.write(v[1])})" if v else name

    def holders(self, values: list[tuple[str, T.Value]]) -> set[str]:
        """The present values that hold some of these, found through the bounds of their stars' blocks."""
        at, found = {(head, self.levels, 0): [v for h, v in values if h == head] for head, _ in values}, set()
        while at:
            place = {f"s\n{h}\n{level}\n{i}": (h, level, i) for h, level, i in at}
            got, further = self.read(sorted(place)), {}
            for key, body in sorted(got.items()):
                (h, level, _), asked = place[key], at[place[key]]
                for kid in json.loads(body):
                    if level == 0:
                        self.kinds({kid})
                        other = self.value(kid)
                        if other and any(_holds(other[1], v) for v in asked):
                            found.add(kid)
                    elif inside := [v for v in asked if _may_hold(kid, v)]:
                        further[h, level - 1, kid["i"]] = inside
            at = further
        return found

    def below(self, sub: str, sup: str) -> bool:
        self.kinds({sub, sup})
        start, goal = self.spelled(sub), self.spelled(sup)
        aim = self.value(goal)
        self.parents({start})
        if not self.value(start) and self.up[start] is None:
            return False
        if goal in (start, "*"):
            return True
        reached, front = {start}, {start}
        while front:
            self.parents(front)
            self.kinds(front)
            typed = {n: v for n in front if (v := self.value(n)) and (n == start or v[0] in (self.up[n] or ()))}
            step = {p for n in front for p in self.up[n] or ()} | {h for h, _ in typed.values()}
            if goal in step or (aim and any(h == aim[0] and _holds(aim[1], v) for h, v in typed.values())):
                return True
            step |= self.holders(list(typed.values())) if typed else set()
            front = step - reached
            reached |= front
        return goal in reached


def _holds(outer: T.Value, inner: T.Value) -> bool:
    return outer.space == inner.space and T.meet(outer, inner) == inner


def _may_hold(bounds: dict, v: T.Value) -> bool:
    """Whether a block with these bounds can have a value that holds v."""
    if v.code is not None:
        return any(bounds["a"] <= v.code[:n] <= bounds["z"] for n in range(1, len(v.code) + 1))
    if v.parts:
        return bounds["hi"] >= float(v.parts[0])
    return bounds["lo"] <= (-_FAR if v.lo is None else float(v.lo)) and bounds["hi"] >= (_FAR if v.hi is None else float(v.hi))


def prove(book: Publication, sub: str, sup: str, units: Units = UNITS) -> dict:
    """A certificate of whether `sub` is below `sup`; only entries that the question touches and their paths reach the driver."""
    touched: dict[str, str | None] = {}
    lines: dict[str, list[str]] = {}

    def read(keys: list[str]) -> dict[str, str]:
        asked = F.filter("entries", lambda e: e["key"].isin(keys)).alias("asked")
        at = book.leaves.where(F.col("prefix").isin(sorted({_digest(k)[: book.depth] for k in keys})))
        rows = at.select("prefix", asked, _lines("entries").alias("lines")).collect()  # a row a key at most
        lines.update({r["prefix"]: list(r["lines"]) for r in rows})
        got = {e["key"]: e["body"] for r in rows for e in r["asked"]}
        touched.update({k: got.get(k) for k in keys})
        return got

    verdict = _Search(read, book.levels, units).below(sub, sup)
    prefixes = sorted({_digest(k)[:n] for k in touched for n in range(book.depth)})
    nodes = book.nodes.where(F.col("prefix").isin(prefixes)).collect() if prefixes else []  # the paths of those keys
    return {
        "sub": sub, "sup": sup, "below": verdict, "depth": book.depth, "levels": book.levels,
        "bodies": {k: b for k, b in touched.items() if b is not None}, "nodes": {r["prefix"]: list(r["lines"]) for r in nodes} | lines,
    }


def verify(certificate: dict, root: str, units: Units = UNITS) -> bool:
    """Whether `sub` is below `sup`, by a certificate that holds against the root; ValueError for one that does not."""
    depth, levels, nodes = certificate["depth"], certificate["levels"], certificate["nodes"]
    digests = {p: _digest("\n".join(lines)) for p, lines in nodes.items()}
    if _root(depth, levels, digests.get("", "")) != root:
        raise ValueError("the certificate is of another root")

    def one(key: str) -> str | None:
        mine, known = _digest(key), digests.get("")
        for n in range(depth + 1):
            if mine[:n] not in nodes or digests[mine[:n]] != known:
                raise ValueError(f"no sound path to {key!r}")
            name = mine if n == depth else mine[: n + 1]
            line = next((x for x in nodes[mine[:n]] if x.startswith(name + ":")), None)
            if line is None:
                return None  # proven absent
            known = line.rpartition(":")[2]
        if _digest(certificate["bodies"].get(key, "")) != known:
            raise ValueError(f"no sound entry for {key!r}")
        return certificate["bodies"][key]

    verdict = _Search(lambda keys: {k: b for k in keys if (b := one(k)) is not None} if digests else {}, levels, units).below(certificate["sub"], certificate["sup"])
    if verdict != certificate["below"]:
        raise ValueError("the certificate claims what its entries deny")
    return verdict
