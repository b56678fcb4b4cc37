import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conegrid.llm import crc_combine, target_sampling

DOCS = "doc_id long, text string, rank string, lang string"
TEXTS = [None, "", "one", "Don't STOP, ÉÉ\x00x１２ end" * 3, "a " * 3000, "x" * 4000, *[f"w{i % 7} common w{i % 3} the-end {i}" * 6 for i in range(40)]]


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest, buckets, percent, least, seed):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(c % buckets for c in features(text, longest)[1])
    for text in target:
        t.update(c % buckets for c in features(text, longest)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out, part = [], []
    for i, text in rows:
        words, crcs = features(text, longest)
        weight = sum(gain[c % buckets] for c in crcs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= least:
                part.append((-score, i, len(out)))
        out.append([i, len(crcs), weight, score, None])
    for k, (_, _, at) in enumerate(sorted(part)[: percent * len(part) // 100], 1):
        out[at][4] = k
    return sorted(map(str, out))


def test_composed_crcs_are_those_of_the_joined_bytes():
    rng = np.random.default_rng(3)
    pieces = [rng.bytes(n) for n in (0, 1, 2, 7, 63, 64, 1000, 70_000)]
    for a in pieces:
        for b in pieces:
            got = crc_combine.joined(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))
            assert got.tolist() == [zlib.crc32(a + b)]


@pytest.mark.parametrize("longest", [1, 3])
def test_feature_crcs_across_stretches(monkeypatch, longest):
    monkeypatch.setattr(target_sampling, "STRETCH", 5)
    for text in TEXTS:
        got = np.concatenate([np.zeros(0, np.uint32), *target_sampling.feature_crcs(target_sampling.words(text), longest, target_sampling.WordCrcs())])
        assert sorted(got.tolist()) == sorted(features(text, longest)[1])


@pytest.mark.parametrize("longest", [1, 2])
def test_resample_matches_brute_force(spark, longest):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[20])]
    frame = spark.createDataFrame([(i, t, "own", "x") for i, t in rows], DOCS)
    target = spark.createDataFrame([("common w1 the",), ("w1 w2",), (None,)], "text string")
    settings = dict(longest=longest, buckets=500, percent=30, least_words=20, seed=7)
    got = target_sampling.resample(frame, target, **settings).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(str(list(r)) for r in got) == brute(rows, ["common w1 the", "w1 w2", None], longest, 500, 30, 20, 7)
    drawn = target_sampling.draw(frame, target, **settings)
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in got if r["rank"]}
    assert drawn.columns == ["doc_id", "text", "lang", "weight", "score", "rank"]


def test_ties_and_empty_tables(spark):
    same = "the same text again and again " * 5
    frame = spark.createDataFrame([(5, same, "", "")] * 40, DOCS)
    none = frame.where(F.lit(False))
    got = target_sampling.resample(frame, frame.select("text"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len(got) == 40
    assert target_sampling.resample(none, frame.select("text")).count() == 0
    assert target_sampling.resample(frame, none.select("text"), percent=0).where("rank is not null").count() == 0
