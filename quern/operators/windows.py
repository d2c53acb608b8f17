"""Window-like operators: quotas, pages, numbering, round robin, running counts, adjacent checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def quota(df: DataFrame, sections: list[str], distinct_by: str, ordering: list[Column], k: int) -> DataFrame:
    """The first k of each section with distinct titles; `available` counts what there was to choose from."""
    one = df.withColumn("_d", F.row_number().over(Window.partitionBy(*sections, distinct_by).orderBy(*ordering))).where("_d = 1").drop("_d")
    w = Window.partitionBy(*sections)
    return one.withColumns({"rank": F.row_number().over(w.orderBy(*ordering)), "available": F.count("*").over(w)}).where(F.col("rank") <= k)


def pages(df: DataFrame, keys: list[str], ordering: list[Column], size: int = 5) -> DataFrame:
    """Page numbers within a section, from 1."""
    return df.withColumn("page", F.ceil(F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)) / size).cast("int"))


def numbered(df: DataFrame, key: str, ordering: list[Column], title: str) -> DataFrame:
    """Titles with (i/n) where a key has several rows."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(*ordering)), F.count("*").over(w)
    return df.withColumn("numbered", F.when(n > 1, F.concat(F.col(title), F.lit(" ("), i.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise(F.col(title)))


def round_robin(df: DataFrame, category: str, ordering: list[Column], limit: int) -> DataFrame:
    """The first of each category, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(*ordering))
    return df.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", category).limit(limit)


def without_repeated_lines(df: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """Texts without lines of `least` characters or more that stand earlier in the same text; built from array functions, so without a shuffle.
    A line's first place is array_position of it, which compares whole lines."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(F.col("_lines"), lambda x, i: (F.length(x) < least) | (F.array_position(F.col("_lines"), x) == i + 1))
    return df.select(key, lines.alias("_lines")).select(key, F.array_join(kept, "\n").alias(text), (F.size("_lines") - F.size(kept)).alias("dropped"))


def _micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def attempts(df: DataFrame, key: str, ts: str, spans: dict[str, int]) -> DataFrame:
    """Attempts of a key within each span of seconds up to each event, and seconds since the one before: the attempt-rate twin of the limiter."""
    at = _micros(F.col(ts))
    w = Window.partitionBy(key).orderBy("_us")
    out = df.withColumn("_us", at)
    for name, seconds in spans.items():
        out = out.withColumn(name, F.count("*").over(w.rangeBetween(-seconds * 1_000_000, 0)))
    return out.drop("_us")


def gaps(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Whole seconds since a key's event before."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumn("gap_s", ((_micros(F.col(ts)) - _micros(F.lag(ts).over(w))) / 1_000_000).cast("long"))


def order_breaks(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Rows that break a non-increasing order."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col(value) > F.col("before"))


def carried(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last non-null value so far, as headings carry over their rows."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"carried_{value}", F.last(value, ignorenulls=True).over(w))


def recent(df: DataFrame, item: str, ts: str, cap: int = 24) -> DataFrame:
    """A move-to-front list: each item at its last use, the newest first."""
    return df.groupBy(item).agg(F.max(ts).alias("last")).orderBy(F.desc("last"), item).limit(cap)


def page_window(current: int, total: int, width: int = 5) -> list[int]:
    """Page numbers around the current one."""
    first = max(1, min(current - width // 2, total - width + 1))
    return list(range(first, min(total, first + width - 1) + 1))
