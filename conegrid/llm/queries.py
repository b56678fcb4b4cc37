"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe_path() -> str:
    """The vocabulary of the packing operator."""
    return _tokenizer("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    ship_package(spark)
    return pack(table(spark, sf_dir, "documents"), byte_bpe_path(), size=1024, end_id=0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    ship_package(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import format_pairs, pair_neighbours

    done = format_pairs(pair_neighbours(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.to_json(c)
    return done.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def _remainder(m: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % m


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ftrl import classify

    ship_package(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(table(spark, sf_dir, "documents"), labels, _remainder(3) == 1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .target_llr import judge

    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    judged = judge(table(spark, sf_dir, "documents"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import train_and_score

    ship_package(spark)
    return train_and_score(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pagediff import main_text

    ship_package(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_langid import identify

    ship_package(spark)
    found = identify(table(spark, sf_dir, "documents"), _remainder(4) == 2)
    return found.withColumn("span_langs", F.to_json("span_langs")).withColumn("span_words", F.to_json("span_words"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_hist import exact_top_k, integer_vectors

    ship_package(spark)
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_duckdb import encode_decode

    ship_package(spark)
    return encode_decode(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .target_sampling import resample

    ship_package(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    ship_package(spark)
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op13_annulus_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annulus_kmeans import cluster_embeddings

    ship_package(spark)
    return cluster_embeddings(table(spark, sf_dir, "embeddings"), dim=64, scale=1024, clusters=8, rounds=10, seed=3)


OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


OP3_SQL = """
WITH conv AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
           sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS said,
           list(mark ORDER BY turn NULLS FIRST, mark) AS key
    FROM (SELECT *, md5(coalesce('1' || role, '0') || chr(1) || coalesce('1' || text, '0')) AS mark FROM conversations)
    WHERE conv_id IS NOT NULL GROUP BY conv_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY key, conv_id) - 1 AS i, count(*) OVER () AS n FROM conv),
pairs AS (
    SELECT CASE WHEN a.said >= b.said THEN a.conv_id ELSE b.conv_id END AS chosen_id,
           CASE WHEN a.said >= b.said THEN b.conv_id ELSE a.conv_id END AS rejected_id,
           CASE WHEN a.said >= b.said THEN a.turns ELSE b.turns END AS c,
           CASE WHEN a.said >= b.said THEN b.turns ELSE a.turns END AS o
    FROM ranked a JOIN ranked b ON b.i = a.i + 1 AND (a.i % 2 = 0 OR b.i = b.n - 1)),
last AS (
    SELECT *, (SELECT max(i) FROM range(1, len(c) + 1) t(i) WHERE c[i].role = 'assistant') AS lc,
           (SELECT max(i) FROM range(1, len(o) + 1) t(i) WHERE o[i].role = 'assistant') AS lo FROM pairs),
branched AS (
    SELECT chosen_id, rejected_id, c,
           CASE WHEN c[1] IS NOT DISTINCT FROM o[1] OR lc IS NULL OR lo IS NULL THEN o ELSE list_concat(c[1:lc - 1], o[lo:]) END AS r FROM last),
cut AS (
    SELECT *, (SELECT coalesce(min(i), least(len(c), len(r)) + 1) FROM range(1, least(len(c), len(r)) + 1) t(i)
               WHERE c[i] IS DISTINCT FROM r[i]) - 1 AS k FROM branched),
turn AS (
    SELECT chosen_id, rejected_id, side, i, t.role AS role, '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) AS piece
    FROM (SELECT chosen_id, rejected_id, 'p' AS side, unnest(c[1:k]) AS t, generate_subscripts(c[1:k], 1) AS i FROM cut
          UNION ALL SELECT chosen_id, rejected_id, 'c', unnest(c[k + 1:]), generate_subscripts(c[k + 1:], 1) FROM cut
          UNION ALL SELECT chosen_id, rejected_id, 'r', unnest(r[k + 1:]), generate_subscripts(r[k + 1:], 1) FROM cut)),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY chosen_id, rejected_id, side ORDER BY i) AS stop FROM turn),
text AS (
    SELECT chosen_id, rejected_id, side, string_agg(piece, '' ORDER BY i) AS body,
           '[' || coalesce(string_agg('[' || (stop - length(piece) + length(coalesce(role, '')) + 5)::BIGINT || ',' || (stop - 1)::BIGINT || ']', ',' ORDER BY i)
               FILTER (WHERE role = 'assistant'), '') || ']' AS mask
    FROM placed GROUP BY chosen_id, rejected_id, side)
SELECT cut.chosen_id, cut.rejected_id, k::BIGINT AS prefix_turns, coalesce(p.body, '') AS prompt,
       coalesce(c.body, '') AS chosen_completion, coalesce(c.mask, '[]') AS chosen_mask,
       coalesce(r.body, '') AS rejected_completion, coalesce(r.mask, '[]') AS rejected_mask
FROM cut LEFT JOIN text p ON p.chosen_id = cut.chosen_id AND p.rejected_id = cut.rejected_id AND p.side = 'p'
LEFT JOIN text c ON c.chosen_id = cut.chosen_id AND c.rejected_id = cut.rejected_id AND c.side = 'c'
LEFT JOIN text r ON r.chosen_id = cut.chosen_id AND r.rejected_id = cut.rejected_id AND r.side = 'r'
"""


# A word's CRC is folded over its bytes (two hexadecimal digits each) with the table of the polynomial.
OP11_SQL = """
WITH tab AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)),
doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
aim AS (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
used AS (SELECT r, unnest(w) AS w FROM doc),
vocab AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM used UNION SELECT w FROM aim)),
crc AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
                      lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
                  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS b
    FROM vocab, tab),
s AS (SELECT b, count(*) AS n FROM used JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM aim JOIN crc USING (w) GROUP BY b),
gain AS (
    SELECT i AS b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
                                   / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
    FROM range(10000) q(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
total AS (SELECT r, sum(g)::BIGINT AS weight FROM used JOIN crc USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM doc LEFT JOIN total USING (r)),
part AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS k, 10 * count(*) OVER () // 100 AS n
    FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n THEN k END AS "rank" FROM scored LEFT JOIN part USING (r)
"""


OP12_SQL = """
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (
    SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM doc),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON a.r = x JOIN size b ON b.r = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
near AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS r, y FROM near UNION SELECT reach.r, near.y FROM reach JOIN near ON near.x = reach.y),
least AS (SELECT reach.r, min(doc.doc_id) AS component FROM reach JOIN doc ON doc.r = reach.y GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(component, doc_id), doc_id) AS component_id
FROM doc LEFT JOIN size USING (r) LEFT JOIN least USING (r)
"""


def op13_sql(clusters: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    """The rounds written out one after another."""
    steps = [f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS m FROM v
    WHERE vec_id IS NOT NULL QUALIFY c < {clusters})"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i} JOIN v USING (r)) GROUP BY c, k),
n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))""")
    last = f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} e ON e.c = a.c
"""
    return ",".join(steps) + last


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_preference, op4_quality_classifier, op5_quality_rules, op6_lm_scoring, op7_page_text, op8_language_id, op9_topk, op10_bpe, op11_target_sampling, op12_jaccard_join, op13_annulus_kmeans)}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference": OP3_SQL, "op9_topk": OP9_SQL, "op11_target_sampling": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_annulus_kmeans": op13_sql()}
