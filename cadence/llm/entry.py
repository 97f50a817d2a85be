"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import bpe, fingerprints, hmm, html, jaccard, kneser, lines, mixing, negatives, neighbours, passages, quality, trie
from cadence.llm.common import read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(read_table(spark, sf_dir, "documents"), size=5, percent=75)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_frame(read_table(spark, sf_dir, "documents"), bpe.model_path(), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op7_substring_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(read_table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and what is left as length and SHA-256."""
    kept = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_fingerprints, op3_sentencepiece, op4_quality_rules, op5_hmm_score, op6_html_text, op7_substring_passages, op8_source_mix, op9_quality_classifier, op10_line_dedup, op11_nearest_vectors, op12_hard_negatives, op13_prefix_trie)}

ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.y = b.y AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
 n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
 SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_prefix_trie": """WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT c, max(t) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda a, b:
  list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, i: xor(p >> 1, (p & 1) * 3988292384))), 4294967295) % 6 AS h FROM own GROUP BY c),
 h AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS hb FROM ids i LEFT JOIN ids b ON b.c = i.c - i.c % 100),
 seq AS (SELECT h.c, o.t AS d, o.role, o.text FROM h JOIN own o ON o.c = h.c - h.c % 100 AND o.t <= h.h UNION ALL SELECT h.c, hb + o.t - h.h, o.role, o.text FROM h JOIN own o ON o.c = h.c AND o.t > h.h),
 path AS (SELECT c, d, length(text) AS size, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM seq UNION ALL SELECT c, 0, 0, '' FROM ids),
 long AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS ends FROM path),
 node AS (SELECT d, k, min(c) AS m, count(*) AS n, any_value(size) AS size, count(*) FILTER (ends) AS n_ends, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS sha FROM long GROUP BY d, k),
 up AS (SELECT v.*, p.k AS pk, u.m AS pm FROM node v LEFT JOIN path p ON p.c = v.m AND p.d = v.d - 1 LEFT JOIN node u ON u.d = p.d AND u.k = p.k),
 kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL), reps AS (SELECT m AS c FROM node WHERE n = n_ends),
 below AS (SELECT p.c, p.d, p.k, sum(CASE WHEN v.m = p.c THEN (v.n - 1) * v.size ELSE 0 END) OVER (PARTITION BY p.c ORDER BY p.d DESC) AS saved, p.c IN (SELECT c FROM reps) AS rep FROM path p JOIN node v ON v.d = p.d AND v.k = p.k),
 sums AS (SELECT d, k, sum(saved) AS saved, count(*) FILTER (rep) AS leaves FROM below GROUP BY d, k)
 SELECT m AS conv_id, u.d AS depth, pm AS parent_conv_id, u.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha AS ends_sha256
  FROM up u JOIN sums USING (d, k) LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k""",
}
