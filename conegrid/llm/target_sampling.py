"""Importance resampling towards a target distribution, on hashed word n-grams.

A feature is a run of 1 to `longest` consecutive words joined by one space; its bucket is the CRC-32 of
its bytes modulo the number of buckets. Each distinct word's CRC is computed once in a task; the
CRCs of longer runs are composed from those by GF(2) length shifts (crc_combine), so no n-gram is ever
a string. A bucket's gain compares its smoothed share among the target's features with that among
the raw corpus's; a document's weight is the sum of its features' gains, and a Gumbel variable
derived from its id turns weights into a draw without replacement.

Counting sums in each task over a fixed number of buckets before anything is shuffled; the table of
gains has that many entries. Scores are ranked by a range partitioning of narrow rows: a task sorts its
range, and the ranges' sizes, one number each, give where its ranks begin. No text is shuffled.

Null text has no words: no features, weight 0. A row without a doc_id is counted in the corpus and
weighed, but has no score, takes no part in the draw and does not count among the N documents. Repeated
rows are documents of their own; equal scores go to the smaller doc_id; rows of one doc_id and score get
consecutive ranks. An empty corpus gives no rows, an empty target a uniform one. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .crc_combine import joined

#: A-Z lower-cased; bytes that end a word (ASCII other than digits and letters) become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Distinct words that a task remembers.
REMEMBERED = 500_000
#: Words of a text that are composed at once.
STRETCH = 1 << 20


class WordCrcs(dict):
    """word -> its CRC-32, and its length above bit 32; computed once a word."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | len(word) << 32
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def feature_crcs(w: list[bytes], longest: int, known: WordCrcs) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to `longest` of the words, repeats included, in pieces of bounded size."""
    for lo in range(0, len(w), STRETCH):
        part = w[lo : lo + STRETCH + longest - 1]  # runs that begin in this stretch may end in the next
        own = min(STRETCH, len(w) - lo)
        packed = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
        crc, size = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        yield crc[:own]
        if longest > 1:
            blank = np.full(len(part), zlib.crc32(b" "), np.uint32)
            spaced, run = joined(blank, crc, size), crc  # " " + word, and the runs so far
            for n in range(2, longest + 1):
                run = joined(run[: max(0, len(part) - n + 1)], spaced[n - 1 :], size[n - 1 :] + 1)
                yield run[:own]


def bucket_counts(texts: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """(bucket, `name`): how often the features of all rows of `texts` (column text) fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total = WordCrcs(), np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                for crcs in feature_crcs(words(text), longest, known):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, name: total[at]})

    return texts.select("text").mapInPandas(count, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Every bucket's gain: floor(1000 ln of its smoothed share in the target over that in the corpus)."""
    both = bucket_counts(docs, longest, buckets, "s").join(bucket_counts(target, longest, buckets, "t"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for bucket, raw, wanted in both.select("bucket", "s", "t").collect():  # at most a row a bucket
        s[bucket], t[bucket] = raw or 0, wanted or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCrcs()
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                w = words(text.as_py())
                rows[0, i] = len(w)
                for crcs in feature_crcs(w, longest, known):
                    rows[1, i] += len(crcs)
                    rows[2, i] += shared.value[crcs % np.uint32(buckets)].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in rows)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """`rows` (doc_id, score, n_features, weight) in order of falling score, then doc_id, with their rank; null after `drawn`.

    The ranges are written before their sizes are counted, so both see the same cuts; the last sort key
    differs between any two rows, so no number of ties lands in one range."""
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.col("doc_id"), F.col("weight"), F.col("n_features"), F.col("_row")]
    dealt = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids of a partition's rows: the partition's number above bit 33, the place in it below
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", before.alias("_before"))  # a row a partition
    rank = F.col("_before") + place + 1
    found = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return found.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs` (doc_id, text): the floor(percent * N / 100)
    highest scores have ranks, N being the documents with at least `least_words` words.

    target: a table with a column text. `draw` gives the drawn documents themselves.
    """
    found = weighed(docs, gains(docs, target, longest, buckets), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    found = materialize(found.withColumn("score", F.col("weight") + gumbel))
    takes_part = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    columns = ["doc_id", "n_features", "weight", "score"]
    n = found.where(takes_part).count()
    order = ranked(found.where(takes_part).select(columns), percent * n // 100)
    return order.unionByName(found.where(~takes_part).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents: `docs` with the columns weight, score and rank, for the doc_ids that were drawn;
    rows that repeat a doc_id are drawn if one of them is, with its best rank."""
    best = resample(docs, target, **settings).where("rank is not null").groupBy("doc_id").agg(F.min_by(F.struct("weight", "score", "rank"), "rank").alias("_drawn"))
    kept = docs.drop("weight", "score", "rank").join(best.withColumnRenamed("doc_id", "_id"), F.col("doc_id").cast("long") == F.col("_id"))
    return kept.select(*[c for c in kept.columns if c not in ("_id", "_drawn")], "_drawn.*")
