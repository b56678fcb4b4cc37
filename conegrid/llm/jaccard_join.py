"""Exact Jaccard join of word-shingle sets: cells, pivots, Voronoi regions and triangle windows.

One minus the Jaccard similarity is a metric, but unrelated texts are all about 1 apart: pivots over a
whole corpus would put every text into every window. So candidates first meet in cells, without loss.
Two linked sets whose larger one lies in a band of sizes differ in at most D shingles; the
universe of shingles is cut into D + 1 slices, so in one of them at least the two sets are equal. A set
is in one cell for each slice, of its own band's cut and of the next band's if it may link upwards.

The least node of a cell is its pivot, and all nodes that meet one pivot in some cell are
its region, so any linked pair lies in a region together. A region is joined in one task: distances to
its pivot link most of it; what is not linked yet is cut by more pivots into Voronoi
regions, each with the nodes of other regions inside the triangle window (the distance to its pivot
at most twice the threshold above that to their own pivot), and these are joined recursively; pairs left over
are excluded by their distances to the pivots or compared exactly. Pairs of one component are not
compared again, since only components and counts are asked for; no group emits all its pairs.

A region over a fixed size is cut into shares, each with the pivot; what then is outside the
region's largest component meets the members in neighbouring shells of distance from the pivot,
block by block. Nothing is dropped: in a large region of unlinked nodes that step grows with the square of its size.

Null text and texts without words have an empty set and link with nothing. Equal sets are one node, repeated rows
keep one result each. A row without a doc_id links others but names no component; its own
component_id is null if nobody else is in it. Sets are held as 64-bit hashes of shingles, told apart by 128 bits. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components
from .idfilter import _marked, without_ids
from .simhash import _runs, shingle_hashes

#: Rows and shingles of a region that are joined in one task.
LIMIT_ROWS, LIMIT_SHINGLES = 4_000, 1 << 21
#: Nodes that are compared without further pivots, and pivots of a level of the recursion.
LEAF, PIVOTS = 24, 12
SALTS = 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Bands:
    """Bands of set sizes for the threshold num / den, and the slices that each band's cut has."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, bounds = num, den, [1]
        while bounds[-1] < 1 << 40:  # a linked partner's size is in the same band or a neighbouring one
            bounds.append(max(5 * bounds[-1] // 4, -(-den * bounds[-1] // num), bounds[-1] + 1))
        self.bounds = bounds
        # sets of sizes a and b that link differ in at most (a + b) * (den - num) / (den + num) shingles
        self.slices = [2 * (hi - 1) * (den - num) // (den + num) + 1 for hi in bounds[1:]]

    def cuts(self, n: int) -> list[int]:
        """The bands whose cut a set of n shingles takes part in."""
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        up = own + 1 < len(self.slices) and self.den * n >= self.num * self.bounds[own + 1]
        # one slice: linked sets are equal, so they are one node already
        return [b for b in ((own, own + 1) if up else (own,)) if self.slices[b] > 1]

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key for each cell that the set of these distinct hashes is in."""
        keys = [np.zeros(0, np.uint64)]
        for b in self.cuts(len(hashes)) if len(hashes) else []:
            g = self.slices[b]
            held = np.zeros(g, np.uint64)
            np.add.at(held, ((hashes >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64), hashes * _ODD[0])
            key = (held + np.arange(1, g + 1, dtype=np.uint64) * _ODD[1] + np.full(g, b + 1, np.uint64) * _ODD[2]) * _ODD[0]
            keys.append(key ^ key >> np.uint64(29))
        return np.concatenate(keys)


class Sets:
    """Sets of distinct hashes, and their exact overlaps."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.n, self.num, self.den = np.array([len(s) for s in sets], np.int64), num, den
        self.start = np.cumsum(self.n) - self.n
        self.values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many hashes set i has in common with each of the others (all sets have some)."""
        mark = np.zeros(len(self.values), bool)
        mark[self.ids[self.start[i] : self.start[i] + self.n[i]]] = True
        if 2 * len(others) > len(self.n):
            return np.add.reduceat(mark[self.ids], self.start, dtype=np.int64)[others]
        size = self.n[others]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.start[others] - first, size)
        return np.add.reduceat(mark[self.ids[at]], first, dtype=np.int64) if len(others) else size

    def compare(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether linked, distance) of set i and each of the others."""
        both = self.overlaps(i, others)
        union = self.n[i] + self.n[others] - both
        return self.den * both >= self.num * union, 1 - both / union


class Region:
    """The join of one region: links that join all nodes of each component."""

    def __init__(self, sets: Sets, label: np.ndarray) -> None:
        self.sets, self.part, self.links = sets, label.copy(), []
        self.tau = 1 - sets.num / sets.den + 1e-9

    def meet(self, i: int, others: np.ndarray) -> np.ndarray:
        """Compare i with the others, join what links, and give the distances."""
        linked, apart = self.sets.compare(i, others)
        for j in others[linked].tolist():
            if self.part[j] != self.part[i]:
                self.links.append((i, j))
                self.part[self.part == self.part[j]] = self.part[i]
        return apart

    def join(self, own: np.ndarray, guests: np.ndarray) -> None:
        """All links within `own` and between it and `guests`."""
        stack = [(own, guests)]
        while stack:
            own, guests = stack.pop()
            here, later = np.concatenate([own, guests]), np.arange(len(own) + len(guests)) >= len(own)
            if not len(own) or (self.part[here] == self.part[here[0]]).all():
                continue
            if len(here) <= LEAF:
                self._pairs(own, here, np.zeros((0, len(here))))
                continue
            # pivots of as many components as there are, then by place
            _, first = np.unique(self.part[own], return_index=True)
            rest = np.setdiff1d(np.arange(len(own)), first)
            chosen = np.concatenate([np.sort(first), rest])[: min(PIVOTS, max(2, int(len(here) ** 0.5)))]
            apart = np.array([self.meet(int(own[p]), here) for p in chosen])
            nearest, least = apart.argmin(0), apart.min(0)
            done = np.zeros(len(here), bool)
            done[chosen] = True  # compared with everything already
            for j in range(len(chosen)):
                mine = np.flatnonzero((nearest == j) & ~later & ~done)
                window = np.flatnonzero((apart[j] <= least + 2 * self.tau) & (later | (nearest > j)) & ~done)
                if len(mine) + len(window) > 0.7 * len(here):  # one dense ball: more pivots would not cut it
                    places = np.concatenate([mine, window])
                    self._pairs(here[mine], here[places], apart[:, places])
                else:
                    stack.append((here[mine], here[window]))

    def _pairs(self, own: np.ndarray, here: np.ndarray, apart: np.ndarray) -> None:
        """Compare each of own (the first of here) with what follows it, unless joined or excluded by a pivot."""
        for at, i in enumerate(own.tolist()):
            open_ = self.part[here[at + 1 :]] != self.part[i]
            if len(apart):
                open_ &= (np.abs(apart[:, at + 1 :] - apart[:, [at]]) <= self.tau).all(0)
            others = here[at + 1 :][open_]
            if len(others):
                self.meet(i, others)


def _search(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, apart, linked) of every region of (region, node, label, pivot, guest, star, text): links, and, where star is
    set, each node's distance from the pivot. Guests meet the others, not one another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _runs(batches, "region"):
            node, out = g["node"].to_numpy(), []
            sets = Sets([np.unique(shingle_hashes(t, k)) for t in g["text"]], num, den)
            region = Region(sets, g["label"].to_numpy())
            guests = np.flatnonzero(g["guest"].to_numpy(bool))
            own = np.flatnonzero(~g["guest"].to_numpy(bool))
            if g["pivot"].iat[0]:  # sorted: the pivot first
                apart = region.meet(0, np.arange(1, len(g)))
                own = own[1:]
                if g["star"].iat[0]:
                    out = [(node[0], node[j + 1], d, False) for j, d in enumerate(apart.tolist())]
            region.join(own, guests)
            out += [(node[i], node[j], 0.0, True) for i, j in region.links]
            yield pd.DataFrame(out, columns=["a", "b", "apart", "linked"]).astype({"a": "int64", "b": "int64", "apart": "float64", "linked": "bool"})

    dealt = rows.repartition("region").sortWithinPartitions("region", "guest", F.desc("pivot"), "node")
    return dealt.select("region", "node", "label", "pivot", "guest", "star", "text").mapInPandas(run, "a long, b long, apart double, linked boolean")


def _met(rows: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join with `few`, one row a key; rows of one key are dealt into shares by the column `by`, as a key may have a third of all rows."""
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def sketches(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """(rid, doc_id, t, c, n, cells): t names the text, c the set, each in 128 bits."""
    kind = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, cells = np.zeros((2, batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.int64), []
            for i, text in enumerate(batch.column(3)):
                u = np.unique(shingle_hashes(text.as_py(), k))
                n[i], raw = len(u), u.tobytes()
                c[:, i] = xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)
                cells.append(bands.cells(u))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *cells]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), pa.array(n), lists], schema=kind)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    made = named.mapInArrow(run, "doc_id long, t1 long, t2 long, c1 long, c2 long, n long, cells array<long>")
    return made.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.struct("t1", "t2").alias("t"), "c1", "c2", "n", "cells")


def _grid(known: DataFrame, tau: float) -> DataFrame:
    """Groups (region, node, label, guest) in which all that is outside a hot region's largest component
    meets the region's members of its own and the neighbouring shells around the pivot.
    known: (pivot, node, label, apart, rows), rows being how many a group may have."""
    sizes = known.groupBy("pivot", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), (F.sum("m") - F.max("m")).alias("rest")).where("rest > 0")
    # wider than the threshold by far more than a rounding error
    shelled = materialize(known.join(largest, "pivot").withColumn("shell", F.floor(F.col("apart") / (tau * (1 + 1e-6)))))
    near = F.explode(F.sequence(F.col("shell") - 1, F.col("shell") + 1))
    visitors = shelled.where("label <> largest").withColumn("shell", near)
    counts = shelled.groupBy("pivot", "shell").agg(F.count("*").alias("members")).join(visitors.groupBy("pivot", "shell").agg(F.count("*").alias("visitors")), ["pivot", "shell"])
    half = F.greatest(F.floor(F.col("rows") / 2), F.lit(1))
    blocks = lambda of: F.ceil(F.col(of) / half)
    own = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), blocks(of).cast("long") - 1))
    counts = materialize(counts)
    here = shelled.join(counts, ["pivot", "shell"]).withColumn("i", own("members", 2)).withColumn("j", every("visitors")).withColumn("guest", F.lit(True))
    come = visitors.join(counts, ["pivot", "shell"]).withColumn("j", own("visitors", 3)).withColumn("i", every("members")).withColumn("guest", F.lit(False))
    both = here.unionByName(come).select(F.xxhash64("pivot", "shell", "i", "j").alias("region"), "node", "label", "guest")
    # a visitor may be a member of the same group: once is enough, as a visitor
    return both.groupBy("region", "node", "label").agg(F.min("guest").alias("guest"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, rows: int = LIMIT_ROWS, shingles: int = LIMIT_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of similarity num / den or more lead to."""
    bands, tau = Bands(num, den), 1 - num / den
    made = materialize(sketches(docs, k, bands))
    equal = made.where("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("c1", "c2", "first")
    nodes = materialize(_met(made.select("rid", "doc_id", "n", "c1", "c2"), equal, ["c1", "c2"], "rid").select("rid", "doc_id", "n", F.coalesce("first", "rid").alias("node")))
    copies = nodes.where("rid <> node").select("rid")
    entries = without_ids(made.where("n > 0").select("rid", "n", "cells"), copies, "rid").select(F.explode("cells").alias("cell"), F.col("rid").alias("node"), "n")
    shared = entries.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("held")).where("held > 1")
    shared = materialize(shared.select("cell", F.col("p.node").alias("pivot"), F.col("p.n").alias("size")))
    meeting = _marked(entries, shared, "cell", 24).where("_maybe").join(shared.hint("merge"), "cell").where("node <> pivot")
    members = materialize(meeting.select("pivot", "size", "node").distinct())
    # sizes of a cell's sets lie within a band of each other, so the pivot's tells how long a region's texts are
    most = F.greatest(F.least(F.lit(rows), F.floor(F.lit(shingles) / F.col("size"))), F.lit(2))
    regions = members.groupBy("pivot").agg((F.count("*") + 1).alias("held"), F.max("size").alias("size"))
    regions = materialize(regions.select("pivot", "held", most.cast("long").alias("rows")))
    placed = materialize(members.select("pivot", "node").unionByName(regions.select("pivot", F.col("pivot").alias("node"))).join(regions, "pivot"))
    names = made.select(F.col("rid").alias("node"), "t")
    wanted = materialize(names.join(placed.select("node").distinct(), "node", "left_semi"))
    whole = docs.select(F.struct(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).alias("t"), "text")
    keys = wanted.select("t").distinct()
    texts = _marked(whole, keys, "t", 24).where("_maybe").drop("_maybe").join(keys.hint("merge"), "t").dropDuplicates(["t"])

    def search(asked: DataFrame) -> DataFrame:
        return _search(asked.join(wanted, "node").join(texts, "t"), k, num, den)

    no = F.lit(False)
    cold = placed.where("held <= rows").select(F.col("pivot").alias("region"), "node", F.col("node").alias("label"), (F.col("node") == F.col("pivot")).alias("pivot"), no.alias("guest"), no.alias("star"))
    found = search(cold).select("a", "b")
    hot = placed.where("held > rows")
    if not hot.isEmpty():
        shares = F.ceil(F.col("held") / (F.col("rows") - 1)).cast("long")
        dealt = hot.where("node <> pivot").withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), shares))
        lead = regions.where("held > rows").withColumn("node", F.col("pivot")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        dealt = dealt.select("pivot", "node", "share").unionByName(lead.select("pivot", "node", "share"))
        first = dealt.select(F.xxhash64("pivot", "share").alias("region"), "node", F.col("node").alias("label"), (F.col("node") == F.col("pivot")).alias("pivot"), no.alias("guest"), F.lit(True).alias("star"))
        seen = materialize(search(first))
        found = materialize(found.unionAll(seen.where("linked").select("a", "b")))
        labels = connected_components(found)
        star = seen.where("NOT linked").select(F.col("a").alias("pivot"), F.col("b").alias("node"), "apart")
        apart = hot.select("pivot", "node", "rows").join(star, ["pivot", "node"], "left").withColumn("apart", F.coalesce("apart", F.lit(0.0)))
        known = materialize(apart.join(labels, "node", "left").select("pivot", "node", "rows", "apart", F.coalesce("component", "node").alias("label")))
        second = _grid(known, tau).withColumns({"pivot": no, "star": no})
        found = found.unionAll(search(second).select("a", "b"))
    parts = connected_components(found)
    labelled = materialize(nodes.join(parts, "node", "left").select("rid", "doc_id", "n", F.coalesce("component", "node").alias("label")))
    several = labelled.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("first"), F.count("*").alias("held")).where("held > 1").select("label", "first")
    return _met(labelled, several, ["label"], "rid").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
