"""The corpus pipeline: quality rules, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conegrid.llm.crf_langid import familiar_features, fit, predict
from conegrid.llm.packing import pack
from conegrid.llm.queries import byte_bpe_path
from conegrid.llm.simhash import keep_one
from conegrid.llm.target_llr import judge
from conegrid.session import materialize, ship_package, table

#: A text is rejected as of no known language below this mean share of familiar features in its words;
#: the chances of the labels sum to 1, so with few languages they can reject nothing.
LEAST_FAMILIAR = 0.6


#: What the stages read; other columns travel packed in one, so that no name of theirs meets a stage's own.
READ = ("doc_id", "text", "lang")


def _packed(docs: DataFrame) -> DataFrame:
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rest = [x for x, c in zip(rest, docs.columns, strict=True) if c not in READ]
    return docs.select(*[c for c in READ if c in docs.columns], (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in READ else F.col("_rest")[f"c{i}"].alias(c) for i, c in enumerate(columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold; trusted: labelled quality 1."""
    judged = judge(_packed(docs), table(spark, sf_dir, "labels").where("quality = 1"))
    # a row number in the condition keeps the filter above the projections: pushed through them, it
    # would compute the arrays once for each of their elements
    judged = judged.withColumn("_row", F.monotonically_increasing_id())
    return _unpacked(judged.where("kept AND _row >= 0"), docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; lang becomes the predicted one."""
    ship_package(spark)
    rows = _packed(docs)
    named = predict(rows, fit(rows, F.lit(True)), familiar_features(rows, F.lit(True)))
    kept = named.where((F.col("_language.lang_pred") != "und") & (F.col("_language.familiar") >= LEAST_FAMILIAR))
    return _unpacked(kept.withColumn("lang", F.col("_language.lang_pred")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    ship_package(spark)
    return _unpacked(keep_one(_packed(docs), k=5, similarity=0.8), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 tokens."""
    ship_package(spark)
    return pack(docs, byte_bpe_path())


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", packing)]

#: Training a field of words and tokenising are not SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
