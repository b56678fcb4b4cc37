"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Features are hashed 1- and 2-grams of a text's words and of the words' shapes (runs of upper case,
lower case, digits and signs), and whether a word repeats the one before; each counts in proportion
to the text's length, so that whole texts of any length compare. Training takes at most
`max_labelled` labelled documents (the least by a hash of the id, so the choice does not depend on
order or layout), spread over shards that each run FTRL-proximal updates; the shards' weights are
averaged. The model is a table of 2**bits numbers, whatever the corpus; scoring is a sparse dot
product in one pass without a shuffle.

Null or empty text has no features and scores by the bias alone; without labelled rows every score is
0.5; a repeated label of one doc_id counts once (the greater value wins), null labels not at all;
repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Words(dict):
    """Word to (hash, hash of its shape); bounded per worker."""

    def __missing__(self, w: bytes) -> tuple[int, int]:
        got = crc32(w), crc32(_RUN.sub(rb"\1", w.translate(_SHAPE)), 7)
        if len(self) < 500_000:
            self[w] = got
        return got


_words = _Words()


def features(text: str | None, bits: int) -> np.ndarray:
    """Buckets of a text's features, repeats included."""
    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([_words[w] for w in words], np.uint64)
    w, s = h[:, 0], h[:, 1]
    a, b, m = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - bits)
    same = (w[1:] == w[:-1]).astype(np.uint64)
    mixed = [w * a, s * b + np.uint64(1), (w[1:] * a ^ w[:-1]) * b, (s[1:] * b ^ s[:-1]) * a + same, same + np.uint64(3)]
    return (np.concatenate([x * a >> m for x in mixed])).astype(np.int64)


def train(examples: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, scale: float) -> np.ndarray:
    """FTRL-proximal over (buckets, label) in the given order; the last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    weigh = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))
    made = []
    for buckets, y in examples:
        i, c = np.unique(buckets, return_counts=True)
        made.append((np.append(i, size - 1), np.append(c * (scale / max(1, len(buckets))), 1.0), y))
    for _ in range(epochs):
        for i, x, y in made:
            w = weigh(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weigh(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, bits: int = 18, max_labelled: int = 12_000, shards: int = 6, epochs: int = 4,
        alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, scale: float = 20.0) -> np.ndarray:
    """Averaged weights from at most `max_labelled` of the labelled documents."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(may_learn)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # a bounded table, hence the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[crc32(str(i).encode()) for i in pdf["doc_id"]]).sort_values(["order", "doc_id", "text"])
        w = train([(features(t, bits), int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True)], bits, epochs, alpha, beta, l1, l2, scale)
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(i, -1), "w": np.append(w[i], 1.0)})

    got = rows.groupBy("shard").applyInPandas(one, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    total = dict(zip(got["i"], got["w"], strict=True))
    out = np.zeros((1 << bits) + 1)
    for i, w in total.items():
        if i >= 0:
            out[i] = w / total[-1]
    return out


def score(docs: DataFrame, weights: np.ndarray, bits: int = 18, scale: float = 20.0) -> DataFrame:
    """`docs` with score, the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            out = []
            for t in texts:
                f = features(t, bits)
                s = float(w[-1]) + (scale * float(w[f].mean(dtype=np.float64)) if len(f) else 0.0)
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, s)))))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", chance("text"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels (doc_id, label) not held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
