"""Quality rules as DataFrame expressions: plain counts, and a hashed n-gram log-likelihood ratio.

The ratio compares two smoothed multinomials over hashed word n-grams (n = 1 and 2): one counted over trusted target documents, one over the whole raw corpus. A document's
score is the mean log ratio of its n-grams, so length does not matter; every document is held against
one threshold, with no sampling. The threshold is given, or lies four standard deviations below the
mean score of a fifth of the trusted documents that the target is not counted over: by Cantelli's
inequality at most one in 17 documents like the trusted ones falls below it, whatever their
distribution. Counting takes one pass with map-side sums over a fixed number of buckets; the table of
log ratios has that many entries, whatever the corpus, and only trusted texts are shuffled.

Everything is DataFrame or SQL functions: no Python runs on executors. Null text has no words; a text
without words scores 0 and fails the base rules; without trusted documents the target is uniform and,
no threshold being given, only the base rules reject; repeated rows are judged alike and counted each;
an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .idfilter import with_ids

WORD = r"[^\x20\x09-\x0D]+"
#: The characters counted as symbols (fixed by the contract).
NOT_SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def base_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """`docs` with the columns _hashes (of its words), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    counted = docs.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    counted = counted.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    counted = counted.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # windows are compared by a 64-bit hash over their words' hashes
        "_windows": F.expr(f"transform(slice(_hashes, 1, greatest(size(_hashes) - {window - 1}, 0)), (x, i) -> xxhash64(x, {', '.join(f'_hashes[i + {k}]' for k in range(1, window))}))"),
    })
    # Windows sorted with their places; those equal to a neighbour occur twice or more; the words
    # they cover are counted from the gaps between places.
    covered = f"""
        aggregate(transform(array(sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i)))), s ->
            sort_array(transform(filter(sequence(0, size(s) - 1),
                j -> coalesce(s[j].h = get(s, j - 1).h, false) OR coalesce(s[j].h = get(s, j + 1).h, false)), j -> s[j].i))),
            0L, (a, p) -> aggregate(sequence(0, size(p) - 1), 0L,
                (n, j) -> n + least({window}, coalesce(get(p, j + 1) - p[j], {window}))))"""
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(F.expr(covered))
    return counted.withColumn("n_repeat_words", repeats).drop("_windows", "_lines", "_words")


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of a text's single words and of its pairs of neighbouring words, from the words' hashes."""
    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda x, i: F.pmod(F.xxhash64(F.get(hashes, i), x), F.lit(buckets)))
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, F.lit(buckets))), pairs)


def _bucket_counts(texts: DataFrame, buckets: int, name: str, text: str = "text") -> DataFrame:
    """(bucket, `name`): how often the n-grams of all these texts fall into each bucket."""
    hashed = texts.select(F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_hashes"))
    return hashed.select(F.explode(_grams(F.col("_hashes"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, text: str = "text") -> DataFrame:
    """One row: `ratios`, the log ratio of every bucket in order, of the texts of `trusted` against those of `docs`."""
    both = _bucket_counts(docs, buckets, "raw", text).join(_bucket_counts(trusted, buckets, "target", text), "bucket", "full")  # at most a row a bucket
    zero = F.lit(0).cast("long")
    listed = both.agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct(F.coalesce("raw", zero).alias("raw"), F.coalesce("target", zero).alias("target"))))).alias("m"),
        F.coalesce(F.sum("raw"), zero).alias("raw_n"), F.coalesce(F.sum("target"), zero).alias("target_n"),
    )
    share = lambda b, of: F.log((F.coalesce(F.col("m")[b][of], zero) + smoothing) / (F.col(f"{of}_n") + smoothing * buckets))
    return listed.select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: share(b, "target") - share(b, "raw")).alias("ratios"))


def mean_ratio(hashes: Column, n_words: Column, table: Column, buckets: int) -> Column:
    """The mean log ratio of a text's n-grams; 0 of none."""
    total = F.aggregate(_grams(hashes, buckets), F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    return total / F.greatest(2 * n_words - 1, F.lit(1))


def calibrated(held: DataFrame, ratios: DataFrame, buckets: int, deviations: float) -> DataFrame:
    """One row: `threshold`, so many standard deviations below the mean score of trusted texts that the
    target was not counted over; with fewer than two of them nothing is rejected. Scores are summed
    as decimals, so the result does not depend on the order of rows."""
    scored = held.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_hashes")).withColumn("_table", F.broadcast(ratios).scalar())
    llr = mean_ratio(F.col("_hashes"), F.size("_hashes"), F.col("_table"), buckets)
    x = scored.where(F.size("_hashes") >= 10).select(llr.cast("decimal(18,9)").alias("x"))
    sums = x.agg(F.count("*").alias("n"), F.sum("x").cast("double").alias("s"), F.sum((F.col("x") * F.col("x")).cast("decimal(28,12)")).cast("double").alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(F.when(F.col("n") > 1, mean - deviations * F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).otherwise(F.lit(float("-inf"))).alias("threshold"))


def judge(docs: DataFrame, target_ids: DataFrame, buckets: int = 4096, smoothing: float = 5.0, threshold: float | None = None, deviations: float = 4.0, filter_bits: int = 24) -> DataFrame:
    """`docs` with the base counts, base_failed, llr (mean log ratio) and kept; columns of those names,
    if `docs` has them, are replaced.

    target_ids: a column doc_id of the trusted documents. threshold: None takes the calibrated one,
    from a fifth of the trusted documents (by a hash of the id) that the target multinomial leaves out.
    """
    # one row an id before the join, so that repeated labels cannot repeat documents
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = ids if threshold is not None else ids.where(~held)
    ratios = materialize(log_ratios(docs, with_ids(own, trusted, "doc_id", filter_bits), buckets, smoothing))
    if threshold is None:
        least = materialize(calibrated(with_ids(own, ids.where(held), "doc_id", filter_bits), ratios, buckets, deviations))
        bound = F.broadcast(least).scalar()
    else:
        bound = F.lit(threshold)
    counted = base_counts(docs)
    # the table of ratios has `buckets` numbers: read once, it is a constant of the scoring plan
    scored = counted.withColumn("_table", F.broadcast(ratios).scalar())
    return (
        scored.withColumn("llr", mean_ratio(F.col("_hashes"), F.col("n_words"), F.col("_table"), buckets))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= bound))
        .drop("_hashes", "_table")
    )
