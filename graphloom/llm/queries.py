"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, html_main, jaccard_join, language_id, mixing, periodic_runs, pii, quality, simhash, token_count, toxicity
from .common import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op2_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_output_code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op5_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op7_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_line_block_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op11_partition_refinement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_radix_sorted_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT doc_id, t, n, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST) AS turn FROM d
)
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, sha256(n) AS text_sha256 FROM g
"""

OP12_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
), f AS (
  SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 100
), cut AS (
  SELECT lang, g, f AS a, c, list_slice(g, 1, c) AS lg, list_slice(g, c + 1, k) AS rg FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)
), cuts AS (
  SELECT cut.lang, cut.g, cut.a, t.n, c, l.f AS l, r.f AS r, CAST(1000 AS HUGEINT) * cut.a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cut JOIN totals t ON t.lang = cut.lang JOIN f l ON l.lang = cut.lang AND l.g = cut.lg JOIN f r ON r.lang = cut.lang AND r.g = cut.rg
), best AS (
  SELECT lang, g, a, n, arg_min({'l': l, 'r': r, 'score': score}, score * 10 + c) AS m FROM cuts GROUP BY lang, g, a, n
), inner_parts AS (
  SELECT lang, list_slice(g, i, i + k2 - 1) AS g, max(f) AS longer
  FROM (SELECT lang, g, f, k2, unnest(range(1, k - k2 + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS k2) WHERE k2 < k) GROUP BY 1, 2
), kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, m.l AS l, m.r AS r, n, m.score AS score
  FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.g = b.g WHERE p.longer IS NULL OR 100 * p.longer < 100 * b.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank, phrase, a, l, r, n, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT d, doc_id, CASE WHEN len(w) < 4 THEN w ELSE list_slice(w, i, i + 3) END AS g FROM (SELECT d, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT d, doc_id, count(*) AS n FROM s GROUP BY d, doc_id
), pairs AS (
  SELECT a.d AS a, b.d AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.d <> b.d GROUP BY a.d, b.d
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.d = a JOIN n y ON y.d = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT d AS a, d AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), named AS (
  SELECT r.a AS d, min(n.doc_id) AS component_id FROM reach r JOIN n ON n.d = r.b GROUP BY r.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE component_id END AS component_id
FROM w LEFT JOIN n ON n.d = w.d LEFT JOIN named ON named.d = w.d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_distribution_divergence, op2_patricia_exact_dedup, op3_heap_token_counts, op4_output_code_languages, op5_subset_sum_mixing,
        op6_multi_index_simhash, op7_block_max_toxicity, op8_boosted_personal_data, op9_line_block_main_text, op10_segment_tree_bpe,
        op11_partition_refinement_runs, op12_radix_sorted_collocations, op13_signature_tree_join, pipeline,
    ]
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_patricia_exact_dedup": OP2_SQL, "op12_radix_sorted_collocations": OP12_SQL, "op13_signature_tree_join": OP13_SQL}
