import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from conegrid.llm import crf_langid


def test_stretches_hold_a_bounded_number_of_words():
    """Many long texts are not labelled at once; every text is in one stretch, in order."""
    texts = pd.Series(["a b " * 6_000] * 5 + ["word"] * 600 + [None, "x " * 50_000, "y"])
    cuts = list(crf_langid.stretches(texts))
    assert [i for lo, hi in cuts for i in range(lo, hi)] == list(range(len(texts)))
    assert all(hi - lo == 1 or hi - lo <= 256 and sum(len((t or "").split()) for t in texts[lo:hi]) <= crf_langid.AT_ONCE for lo, hi in cuts)
    assert (0, 1) in cuts and list(crf_langid.stretches(texts[:0])) == []


def test_familiar_features_count_every_document(spark):
    """A word of many documents is familiar wherever these stand in the order that learning takes documents in."""
    docs = spark.range(2_200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    order = docs.select("doc_id", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("n"))
    docs = docs.join(order, "doc_id").withColumn("text", F.when(F.col("n") > 2_000, F.lit("zebra")).otherwise(F.lit("plain")))
    seen = crf_langid.familiar_features(docs, F.lit(True))
    assert seen[crf_langid.word_features(["zebra"])[0]].all() and seen[crf_langid.word_features(["plain"])[0]].all()
    assert not seen[crf_langid.word_features(["quartz"])[0]].all()
