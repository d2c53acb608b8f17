"""The subpackage's queries: production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.media import media_digest

    return media_digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.substrings import removed_words

    return removed_words(_read(spark, sf_dir, "documents", "doc_id", "text"))


SQL2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, k, md5(array_to_string(w[k : k + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(k, k + 34)) AS p FROM again),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS s FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.bpe import encode_digest

    return encode_digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import classify

    return classify(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.recurrent import score

    return score(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontam import find_contamination

    return find_contamination(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL6 = f"""
WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS6} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.k, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii import digest

    return digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import identify

    return identify(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_html_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html import extract

    return extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_minhash_near_duplicates": op7_minhash_near_duplicates,
    "op8_pii_boosted": op8_pii_boosted,
    "op9_language_crf": op9_language_crf,
    "op10_html_template_extraction": op10_html_template_extraction,
}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": SQL2, "op6_benchmark_decontamination": SQL6}
