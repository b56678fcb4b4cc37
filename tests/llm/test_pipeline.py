import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from conegrid.llm import packing

#: Columns that stages use themselves, as other columns of the input with types of their own.
CLASH = {"kept": "string", "n_words": "string", "llr": "string", "_row": "string", "_rest": "string", "_": "string", "_language": "string", "base_failed": "string", "row": "int", "a.b": "string"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {t}" for c, t in CLASH.items())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, *(["own"] * 8), 7, "own") for i, t, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    parts = {"en": ["an", "der", "ing", "tion", "th", "es", "on"], "es": ["que", "lla", "os", "ci", "ar", "mo", "ez"]}
    prose = lambda a: " ".join("".join(rng.choice(a, rng.integers(1, 4))) for _ in range(60))
    rows = [(i, prose(parts[("en", "es")[i % 2]]), ("en", "es")[i % 2]) for i in range(120)]
    w = rows[3][1].split()
    rows += [(200, rows[3][1], "es"), (201, " ".join([*w[:-1], "other"]), "es"), (202, "too short", "en"), (203, None, "en"), (204, "", None), (205, "same words again and again " * 20, "en")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame(spark, [*rows, rows[0]]).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages_keep_clashing_columns_and_decide(spark, data):
    folder, rows = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        done = stage(spark, docs, folder)
        assert done.dtypes == docs.dtypes, name
        docs = pipeline.materialize(done)
        got = docs.collect()
        assert {(r["doc_id"], r["text"]) for r in got} <= before
        assert all(r[c] in ("own", 7) for r in got for c in CLASH)
        if name == "quality_rules":
            assert not {202, 203, 204, 205} & {r["doc_id"] for r in got} and len(got) > 100
    ids = sorted(r["doc_id"] for r in got)
    assert 200 not in ids and 201 not in ids and 3 in ids and len(ids) == len(set(ids)) == 120
    pieces = pipeline.packing(spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)


def test_run_is_the_stages_in_turn(spark, data):
    folder, _ = data
    got = pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, folder))
    want = packing.pack(docs, pipeline.byte_bpe_path())
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_empty_tables(spark, data):
    folder, _ = data
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
