"""De-duplication and set operations.  Each keeps one row of a key by an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(df: DataFrame, keys: list[str], *ordering: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))).where("_n = 1").drop("_n")


def best_of(df: DataFrame, keys: list[str], *rank: Column) -> DataFrame:
    """The best row of each key by a struct of ranks, with map-side pre-aggregation (no sort of a whole group)."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*rank)).alias("_row"))
    return best.select(*keys, *(F.col("_row").getField(c).alias(c) for c in names))


def last_wins(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row's values at the place of the key's first row (column `place`)."""
    names = [c for c in df.columns if c not in (*keys, at)]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(at)).alias("_row"), F.min(at).alias("place"))
    return out.select(*keys, *(F.col("_row").getField(c).alias(c) for c in names), "place")


def first_by_either(df: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """First rows by either of two keys, in two passes: first of each a, then first of each b of what stays.  A deterministic form of an
    order-sensitive fold, which differs only where a row dropped in the first pass would have hidden one in the second."""
    return first_of(first_of(df, [a], F.col(at)), [b], F.col(at))


def stories(df: DataFrame, story: Column, quality: Column) -> DataFrame:
    """Best by id, then best by story: quality, then date, then the lowest id; both as windows."""
    one = df.withColumns({"_story": story, "_quality": quality})
    one = first_of(one, ["id"], F.desc("_quality"), F.desc("date"), F.col("place"))
    return first_of(one, ["_story"], F.desc("_quality"), F.desc("date"), F.col("id")).drop("_story", "_quality")


def replace_sources(old: DataFrame, new: DataFrame, keep_when_smaller: bool = True) -> DataFrame:
    """Rows of refreshed sources from `new`, of all others from `old`; a source whose new set is smaller keeps its old rows."""
    fresh = new.groupBy("sourceId").agg(F.count("*").alias("_new"))
    stale = old.groupBy("sourceId").agg(F.count("*").alias("_old"))
    took = fresh.join(stale, "sourceId", "left").where((F.col("_new") >= F.coalesce("_old", F.lit(0))) | F.lit(not keep_when_smaller)).select("sourceId")
    return old.join(took, "sourceId", "left_anti").unionByName(new.join(took, "sourceId", "left_semi"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side they are on."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.count_distinct(rest).alias("versions")).where("versions > 1")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the longest body, the union of categories, the least of each order."""
    return df.groupBy(*keys).agg(F.max_by("body", F.length("body")).alias("body"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def capped_insert(df: DataFrame, key: str, at: str, cap: int) -> DataFrame:
    """The first `cap` new keys in order; later rows of those keys still add their tags."""
    firsts = df.groupBy(key).agg(F.min(at).alias("place"), F.array_sort(F.collect_set("tag")).alias("tags"))
    return firsts.orderBy("place", key).limit(cap)
