"""The adapted tables, and registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir), with SQL where there is an equivalent."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents from documents: title is the first sentence, snippet the first 280 characters."""
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    kinds = F.array(*(F.lit(m) for m in ("article", "pdf", "image", "video", "broadcast")))
    types = F.array(*(F.lit(m) for m in ("official", "media", "archive", "video", "library")))
    src = F.coalesce("source", F.lit("none"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.split_part(t, F.lit("."), F.lit(1)).alias("title"), F.left(t, F.lit(280)).alias("snippet"), t.alias("body"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd").alias("date"),
        F.coalesce("lang", F.lit("ko")).alias("language"), src.alias("sourceId"), F.concat(F.lit("Source "), F.upper(src)).alias("sourceName"), F.get(types, (i % 5).cast("int")).alias("sourceType"), src.alias("displaySourceId"),
        F.get(kinds, (i % 5).cast("int")).alias("mediaType"), F.concat(F.lit("https://"), src, F.lit(".example.org/"), F.coalesce("lang", F.lit("ko")), F.lit("/"), i.cast("string")).alias("url"), F.lit(999).alias("displayOrder"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension: distinct sources, in order of their id."""
    s = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("id")).distinct()
    return s.select("id", F.concat(F.lit("Source "), F.upper("id")).alias("name"), F.concat("id", F.lit(".example.org")).alias("host"), F.coalesce(F.regexp_extract("id", "(\\d+)$", 1).try_cast("int"), F.lit(99)).alias("place"))


#: The same relations in SQL.
DOCS = """docs AS (SELECT doc_id AS id, split_part(coalesce(text, ''), '.', 1) AS title, left(coalesce(text, ''), 280) AS snippet, coalesce(text, '') AS body,
 strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date, coalesce(lang, 'ko') AS language, coalesce(source, 'none') AS sourceId, 'Source ' || upper(coalesce(source, 'none')) AS sourceName,
 ['official', 'media', 'archive', 'video', 'library'][CAST(doc_id % 5 AS INTEGER) + 1] AS sourceType, ['article', 'pdf', 'image', 'video', 'broadcast'][CAST(doc_id % 5 AS INTEGER) + 1] AS mediaType,
 'https://' || coalesce(source, 'none') || '.example.org/' || coalesce(lang, 'ko') || '/' || CAST(doc_id AS VARCHAR) AS url FROM documents)"""
SOURCES = """sources AS (SELECT DISTINCT coalesce(source, 'none') AS id, 'Source ' || upper(coalesce(source, 'none')) AS name, coalesce(source, 'none') || '.example.org' AS host,
 coalesce(TRY_CAST(regexp_extract(coalesce(source, 'none'), '([0-9]+)$', 1) AS INTEGER), 99) AS place FROM documents)"""
