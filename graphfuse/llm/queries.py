"""Registered queries of the training-data operators, and their SQL where SQL can say them.

Each query applies one operator, with its production parameters, to the whole
of its table and returns the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licenses, near_dup, packing, quality_classifier, quality_rules, repeats, token_count, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_ngram_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.corpus_counts(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_bradley_terry_quality": op1_bradley_terry_quality,
        "op2_cgk_decontamination": op2_cgk_decontamination,
        "op3_license_digests": op3_license_digests,
        "op4_ngram_perplexity_rules": op4_ngram_perplexity_rules,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_toxicity_grammar": op7_toxicity_grammar,
        "op8_hierarchical_packing": op8_hierarchical_packing,
        "op9_separator_scan": op9_separator_scan,
        "op10_language_id": op10_language_id,
    }


#: Exact all-pairs similarity join over shared shingles, then reachability.
OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE
      WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
      ELSE [] END AS s
  FROM w),
sh AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS c
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)
  UNION ALL SELECT b, a FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""


#: Every window of 200 bytes against every other, and what no repeated one covers.
OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
k AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 200) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS MATERIALIZED (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM k GROUP BY 1, 2),
p AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM r
  UNION ALL SELECT doc_id, max(hi), 9223372036854775807 FROM r GROUP BY 1
  UNION ALL SELECT doc_id, 0, 9223372036854775807 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r)),
t AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, a + 1, least(z, octet_length(b)))), '' ORDER BY a)) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, octet_length(b) - octet_length(kept) AS n_removed, coalesce(n, 0) AS n_spans, sha256(kept) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY 1) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_digests": licenses.oracle_sql(),
        "op5_suffix_array_dedup": OP5_SQL,
        "op6_minhash_near_dedup": OP6_SQL,
    }
