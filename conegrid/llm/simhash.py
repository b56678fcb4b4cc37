"""SimHash near-duplicate detection with sharded BK-trees.

A fingerprint's bit is the majority of that bit over the hashes of a text's word shingles. Equal
fingerprints are one node from then on. Fingerprints within radius r of each other agree on at least
two of r + 2 bit blocks, so every node is routed to one shard for each pair of blocks; a shard's
BK-tree (children keyed by their integer Hamming distance to the parent) is built in the task that
holds the shard, and a search follows only the edges within the radius. Trees are not broadcast from
the driver: their number grows with the corpus, and routing brings each tree to just its own queries.
A shard larger than a fixed size becomes a distributed BK level: its root's children are shards of
their own, and a node also visits those that its search has to follow. Nothing is dropped. A shard
reports a spanning forest of its links, never all pairs.

Null text and texts without words have fingerprint zero and are linked like any other; repeated rows
keep one result each; null doc_ids get a fingerprint but cannot name a component; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components
from .idfilter import with_ids, without_ids
from .words import ascii_words

LIMIT = 20_000
#: Values of a BK subtree that are compared at once where the radius is so wide that few edges are ruled out.
LEAF = 256
BANDS, ROWS = 8, 3
SALTS = 32
_MULTIPLY = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle in order, repeats included; of the whole sequence if shorter."""
    w = ascii_words(text)
    if not w:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([digest(b" ".join(w), seed)], "<u8")
    return np.array([digest(b" ".join(w[i : i + k]), seed) for i in range(len(w) - k + 1)], "<u8")


def majority_bits(h: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes; zero of none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): every document's fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([majority_bits(shingle_hashes(t, k)) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fp("text").alias("fp"))


class BKTree:
    """64-bit fingerprints under Hamming distance: a node's children are keyed by their integer distance
    to it. A subtree of at most `leaf` values is kept flat and compared at once; with leaf 1 every value
    is a node."""

    def __init__(self, values: np.ndarray, leaf: int = 1) -> None:
        self.values, self.leaf = values, leaf
        self.top = self._grow(np.arange(len(values)))

    def _grow(self, places: np.ndarray) -> np.ndarray | tuple[int, np.ndarray, dict]:
        """A node (its value, the places of that value, its children), or the places of a flat subtree."""
        todo, made = [(places, None, 0)], None
        while todo:  # without recursion: a tree may be deep
            places, parent, edge = todo.pop()
            if len(places) <= self.leaf:
                node = places
            else:
                value = self.values[places[0]]
                d = np.bitwise_count(self.values[places] ^ value)
                node = (int(value), places[d == 0], {})
                todo += [(places[d == x], node, int(x)) for x in np.unique(d[d > 0])]
            if parent is None:
                made = node
            else:
                parent[2][edge] = node
        return made

    def within(self, value: np.uint64, radius: int) -> np.ndarray:
        """Places of all values within the radius, by the edges that can lead to them."""
        stack, found, own = [self.top], [], int(value)
        while stack:
            at = stack.pop()
            if isinstance(at, tuple):
                d = (at[0] ^ own).bit_count()
                if d <= radius:
                    found.append(at[1])
                stack += [at[2][e] for e in at[2].keys() & range(d - radius, d + radius + 1)]
            elif len(at):
                found.append(at[np.bitwise_count(self.values[at] ^ value) <= radius])
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int64), *found])


def spanning_links(fps: np.ndarray, members: int, radius: int, agree: Callable[[int, np.ndarray], np.ndarray] | None = None, part: np.ndarray | None = None,
                   leaf: int = 1) -> list[tuple[int, int]]:
    """A spanning forest of the links among the first `members` fingerprints, and of the visitors
    after them to members. agree(i, places), if given, tells which of those places i is linked to; part, if given, holds
    the components that are known already.

    A place whose component i has joined is not looked at again, so a shard of mutual copies costs a
    comparison of each with the others' fingerprints, and no more than a link a copy."""
    tree, part, out = BKTree(fps[:members], leaf), np.arange(len(fps)) if part is None else part.copy(), []
    for i in range(1, len(fps)):
        near = tree.within(fps[i], radius)
        near = np.sort(near[(near < i) & (part[near] != part[i])])
        step = 1
        while len(near):
            head, near = near[:step], near[step:]
            for j in (head if agree is None else head[agree(i, head)]).tolist():
                if part[j] != part[i]:
                    out.append((j, i))
                    part[part == part[j]] = part[i]
            near = near[part[near] != part[i]]
            step *= 8
    return out


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key, from batches sorted by it."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0][key].iat[0] != k[lo]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _search(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the nodes of each shard of (shard, fp, node, visitor)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for g in _runs(batches, "shard"):
            node, visitor = g["node"].tolist(), g["visitor"].to_numpy(bool)  # sorted: members first
            for x, y in spanning_links(g["fp"].to_numpy(np.int64).view(np.uint64), int((~visitor).sum()), radius):
                a.append(node[x])
                b.append(node[y])
        yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return shards.repartition("shard").sortWithinPartitions("shard", "visitor", "fp").mapInPandas(run, "a long, b long")


def links(nodes: DataFrame, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """Links that join all nodes (fp, node; fp distinct) within the radius, as a spanning set."""
    blocks = radius + 2
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(x | y)))) for i, (x, y) in enumerate(combinations(masks, 2))]
    shards = nodes.select(F.explode(F.array(*keys)).alias("shard"), "fp", "node").withColumn("visitor", F.lit(False))
    out = None
    while True:
        members = F.count(F.when(~F.col("visitor"), 1))
        sizes = shards.groupBy("shard").agg(F.count("*").alias("n"), members.alias("members"), F.min(F.when(~F.col("visitor"), F.col("fp"))).alias("pivot"))
        sizes = materialize(sizes.where("n > 1 and pivot is not null"))
        here = _search(shards.join(sizes.where(F.col("members") <= limit).select("shard"), "shard", "left_semi"), radius)
        out = here if out is None else out.unionAll(here)
        hot = sizes.where(F.col("members") > limit)
        if hot.isEmpty():
            return out
        # one BK level: members go to the child of their distance, and as visitors to the farther
        # children a search follows (the nearer ones visit them); visitors search on both sides
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot")))
        down = shards.join(F.broadcast(hot), "shard").withColumn("d", d)  # hot shards: at most all rows / limit
        down = down.select("shard", "fp", "node", "visitor", "pivot", F.explode(F.sequence(F.when(F.col("visitor"), F.col("d") - radius).otherwise(F.col("d")), F.col("d") + radius)).alias("child"), "d")
        own = F.col("child") == F.col("d")
        shards = materialize(down.select(F.xxhash64("shard", "pivot", "child").alias("shard"), "fp", "node", (F.col("visitor") | ~own).alias("visitor")))
        shards = shards.dropDuplicates(["shard", "fp", "visitor"])


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `radius` bits lead to."""
    fps = materialize(fingerprints(docs, k))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = connected_components(links(nodes.where("node is not null"), radius, limit))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


class ShingleSets:
    """The shingle sets of one shard's texts, and which of them are similar."""

    def __init__(self, sets: list[np.ndarray], similarity: float) -> None:
        self.n = np.array([len(x) for x in sets], np.int64)
        self.start, self.least = np.cumsum(self.n) - self.n, similarity
        _, self.ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        order = np.argsort(self.ids, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.first = np.searchsorted(self.ids[order], np.arange(self.ids.max() + 2 if len(self.ids) else 1))

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity of i with each of the others reaches the least one."""
        mine = self.ids[self.start[i] : self.start[i] + self.n[i]]
        both = np.zeros(len(others), np.int64)
        fit = np.flatnonzero(np.minimum(self.n[others], self.n[i]) >= self.least * np.maximum(self.n[others], self.n[i]))
        if len(fit) <= 16:
            for x in fit.tolist():
                j = others[x]
                both[x] = len(np.intersect1d(mine, self.ids[self.start[j] : self.start[j] + self.n[j]], assume_unique=True))
        else:  # the owners of each of i's shingles, counted
            size = self.first[mine + 1] - self.first[mine]
            at = np.arange(size.sum()) + np.repeat(self.first[mine] - (np.cumsum(size) - size), size)
            both[fit] = np.bincount(self.owner[at], minlength=len(self.n))[others[fit]]
        union = self.n[others] + self.n[i] - both
        return (both >= self.least * union) & (union > 0)


def similar_links(shards: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) between members of each shard of (shard, node, fp, label, visitor, text), and from
    its visitors to its members: the BK-tree proposes fingerprints within the radius, and the shingle
    sets' Jaccard similarity decides. Nodes of one label are linked already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for g in _runs(batches, "shard"):
            node, members = g["node"].tolist(), int((~g["visitor"].to_numpy(bool)).sum())  # sorted: members first
            sets = ShingleSets([np.unique(shingle_hashes(t, k)) for t in g["text"]], similarity)
            for x, y in spanning_links(g["fp"].to_numpy(np.int64).view(np.uint64), members, radius, sets.similar, g["label"].to_numpy(), LEAF):
                a.append(node[x])
                b.append(node[y])
        yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return shards.repartition("shard").sortWithinPartitions("shard", "visitor", "node").mapInPandas(run, "a long, b long")


def hot_links(hot: DataFrame, found: DataFrame, search: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """`found` and the links that it lacks between the members of hot shards (shard, node, fp, n), with
    never more than `limit` rows in a search.

    Members are searched in blocks, then one member of every component that a shard has; what is in
    none of a shard's largest component then meets all its members, block by block. A pair that is not
    compared is of one component already, so nothing is lost."""
    for step in range(2):
        known = labelled(hot, found)
        active = known if step == 0 else known.groupBy("shard", "label").agg(F.min_by(F.struct("node", "fp"), "node").alias("x")).select("shard", "label", "x.node", "x.fp")
        active = materialize(active.select("shard", "label", "node", "fp"))
        size = active.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        cut = active.join(size, "shard").withColumn("block", _block("n", limit, step))
        found = materialize(found.unionAll(search(cut.select(F.xxhash64("shard", "block").alias("shard"), "node", "fp", "label", F.lit(False).alias("visitor")))))
    known = materialize(labelled(hot, found))
    sizes = known.groupBy("shard", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("shard").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), (F.sum("m") - F.max("m")).alias("rest"))
    left = known.join(materialize(largest.where("rest > 0")), "shard")
    half = max(1, limit // 2)
    blocks = lambda n: F.ceil(F.col(n) / _block_rows(half))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    members = left.withColumn("i", _block("n", half, 2)).withColumn("j", every("rest")).withColumn("visitor", F.lit(False))
    visitors = left.where("label <> largest").withColumn("j", _block("rest", half, 3)).withColumn("i", every("n")).withColumn("visitor", F.lit(True))
    pairs = members.unionByName(visitors).select(F.xxhash64("shard", "i", "j").alias("shard"), "node", "fp", "label", "visitor")
    return found.unionAll(search(pairs))


def _block_rows(limit: int) -> int:
    """Rows that a block is meant to have: hashing deals unevenly, so fewer than the limit."""
    return max(1, limit - int(6 * limit**0.5)) if limit > 144 else max(1, limit // 4)


def _block(n: str, limit: int, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col(n) / _block_rows(limit)))


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the label of each node's component."""
    return rows.join(connected_components(found), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


#: The columns whose hash names a row: repeated rows share it, other texts under the same doc_id do not.
ROW = ("doc_id", "text")


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 26, limit: int = LIMIT) -> DataFrame:
    """doc_id, row, component_id, first_row: every row's group, named by its least doc_id; groups linked by Jaccard similarity of k-word shingle sets.

    At 0.8 fingerprints differ in up to about twenty bits, too many for blocks of equal bits; so a
    shard here is a band of minimum hashes that two such texts share with a chance of over 0.99 in
    some band (1 - (1 - 0.8**3)**8 = 0.997). Equal texts are one node. A shard over the limit is cut
    by rows into blocks that meet each other as far as they are not linked yet.
    """
    schema = "row long, doc_id long, content long, fp long, mins array<long>"

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, i, t in zip(pdf["row"].tolist(), pdf["doc_id"].tolist(), pdf["text"], strict=True):
                h = shingle_hashes(t, k)
                content = xxhash.xxh64_intdigest(b" ".join(ascii_words(t)), 7)
                mins = (np.unique(h) * _MULTIPLY[:, None]).min(1) if len(h) else np.zeros(len(_MULTIPLY), np.uint64)
                rows.append((r, int(i), np.uint64(content).astype(np.int64), np.uint64(majority_bits(h)).astype(np.int64), mins.view(np.int64)))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "content", "fp", "mins"])

    named = docs.where("doc_id is not null").select(F.xxhash64(*ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(named.mapInPandas(sketch, schema))
    nodes = sketches.groupBy("content").agg(F.min_by(F.struct("row", "fp", "mins"), "row").alias("x")).select("content", F.col("x.row").alias("node"), "x.fp", "x.mins")
    nodes = materialize(nodes)
    bands = [F.xxhash64(F.lit(b), *[F.get("mins", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)]
    shards = nodes.select("node", "fp", F.explode(F.array(*bands)).alias("shard"))
    # shards of just the same members (copies that share every band) are searched once
    members = shards.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    sizes = materialize(members.where("n > 1").groupBy("n", "s", "x").agg(F.min("shard").alias("shard")).select("shard", "n"))
    chosen = materialize(shards.join(sizes, "shard").select("shard", "node", "fp", "n"))
    # only the texts of nodes that share a shard travel, once a node; then once a shard
    wanted = materialize(chosen.select(F.col("node").alias("row")).distinct())
    texts = with_ids(named.select("row", "text"), wanted, "row").dropDuplicates(["row"])

    def search(rows: DataFrame) -> DataFrame:
        return similar_links(rows.join(texts, rows["node"] == texts["row"]).select("shard", "node", "fp", "label", "visitor", "text"), k, similarity, radius)

    found = search(chosen.where(F.col("n") <= limit).withColumn("label", F.col("node")).withColumn("visitor", F.lit(False)))
    hot = chosen.where(F.col("n") > limit)
    if not hot.isEmpty():
        found = hot_links(hot, materialize(found), search, limit)
    parts = connected_components(found)
    groups = nodes.join(parts, "node", "left").select("content", F.coalesce("component", "node").alias("component"))
    members = materialize(sketches.select("row", "doc_id", "content").join(groups, "content").select("row", "doc_id", "component"))
    firsts = members.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"))
    # a component may hold a third of all rows: its members meet its first row in SALTS shares; one alone needs none
    several = firsts.where("n > 1").select("component", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = members.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(SALTS)).cast("int")).join(several, ["component", "salt"], "left")
    first = F.coalesce("first", F.struct("doc_id", "row"))
    return met.select("doc_id", "row", first["doc_id"].alias("component_id"), first["row"].alias("first_row"))


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each similar group, that of the least doc_id. Texts under one doc_id
    are documents of their own unless they are similar; of equal rows one stays. Rows without a doc_id
    cannot be named by a group and stay. Only texts that go, or occur twice, are shuffled."""
    groups = similar_groups(docs, k, similarity)
    counts = materialize(groups.groupBy("row", "first_row").agg(F.count("*").alias("n")).where("row <> first_row OR n > 1"))
    again = counts.where("row = first_row").select(F.col("row").alias("_row"))
    rows = docs.withColumn("_row", F.xxhash64(*ROW))
    stay = without_ids(rows, counts.select(F.col("row").alias("_row")), "_row")
    if not again.isEmpty():
        stay = stay.unionByName(with_ids(rows, again, "_row").dropDuplicates(["_row"]))
    return stay.drop("_row")
