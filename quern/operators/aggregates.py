"""Aggregates of audits and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def coverage(df: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """Conditional counters over everything (null key) and by key, in one pass."""
    return df.rollup(key).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counters.items()))


def failures(df: DataFrame, a: str, b: str, sample: str) -> DataFrame:
    """Failures by each of two keys alone: count, distinct others, least sample."""
    kept = df.withColumns({"_a": F.col(a), "_b": F.col(b)})
    out = kept.groupingSets([[a], [b]], F.col(a), F.col(b)).agg(F.grouping(a).cast("int").alias("by_b"), F.count("*").alias("n"), F.count_distinct("_a").alias("_as"), F.count_distinct("_b").alias("_bs"), F.min(sample).alias("sample"))
    return out.select(a, b, "by_b", "n", F.when(F.col("by_b") == 0, F.col("_bs")).otherwise(F.col("_as")).alias("others"), "sample")


def with_zeros(counts: DataFrame, keys: DataFrame, name: str = "n") -> DataFrame:
    """Counts for all keys, also those without rows."""
    return keys.join(counts, keys.columns, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def compacted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Archive copies by key: the first id, how many, and their distinct origins in order."""
    return df.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps with the lesser value of each key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.least(x, y))


def assertion(df: DataFrame, key: str, least_total: int, least_sources: int, text: Column) -> DataFrame:
    """A golden query's figures by key, and whether they reach their floors."""
    out = df.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct("sourceId").alias("sources"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.min(F.length(text)).alias("shortest"))
    return out.withColumn("ok", (F.col("total") >= least_total) & (F.col("sources") >= least_sources))
