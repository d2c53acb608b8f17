"""Contracts and audits: row errors, keys, references, guards, coverage, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import dates, urls


def row_errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails; a null check fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def document_checks(languages: tuple[str, ...], media: tuple[str, ...]) -> dict[str, Column]:
    """Checks of a search document."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return {
        **{f"{c}:required": filled(c) for c in ("id", "title", "snippet", "sourceId", "url")}, "date:calendar": dates.calendar(F.col("date")).isNotNull(),
        "language:enum": F.col("language").isin(*languages), "mediaType:enum": F.col("mediaType").isin(*media),
    }


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def host_policy(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents whose URL's host neither equals nor lies below their source's host."""
    known = sources.select(F.col("id").alias("sourceId"), F.col("host").alias("_host"))
    return docs.join(known, "sourceId").where(~urls.under(urls.host(F.col("url")), F.col("_host"))).drop("_host")


def regressed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources whose newest day goes back."""
    a, b = (df.groupBy("sourceId").agg(F.max("date").alias(n)) for df, n in ((old, "was"), (new, "now")))
    return a.join(b, "sourceId").where("now < was")


def stale(df: DataFrame, as_of: str, days: int) -> DataFrame:
    return df.groupBy("sourceId").agg(F.max("date").alias("newest")).where(F.datediff(F.lit(as_of).cast("date"), F.col("newest").cast("date")) > days)


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object outside the allowed ones."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def version(df: DataFrame, *ordering: str, size: int = 16) -> DataFrame:
    """A fingerprint of a table's rows in a fixed order: a hash of each row, then of their list.  Only 64 characters a row meet in one place."""
    rows = df.select(F.struct(*ordering).alias("_o"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns)).cast("binary"), 256).alias("_h"))
    return rows.agg(F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"]), "").cast("binary"), 256), F.lit(size)).alias("version"))


def health(sources: DataFrame, docs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Each source with its documents, newest day and status."""
    counts = docs.groupBy(F.col("sourceId").alias("id")).agg(F.count("*").alias("documents"), F.max("date").alias("newest"))
    out = sources.select("id").join(counts, "id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest").cast("date"))
    return out.withColumn("status", F.when(F.col("documents") == 0, "empty").when(age > days, "stale").otherwise("healthy"))


def contaminated_images(df: DataFrame, least: int = 8) -> DataFrame:
    """Sets of images, of `least` or more, that stand under several (title, date)."""
    keyed = df.where(F.size("images") >= least).withColumn("imageSet", F.array_join(F.array_sort("images"), "\n"))
    return keyed.groupBy("imageSet").agg(F.count_distinct("title", "date").alias("titles")).where("titles >= 2")


def robots(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Whether each path is allowed: the longest matching rule wins, allow beats disallow at equal length, no rule allows.
    A path meets only rules of its host; rules are prefixes, joined by host and prefix length."""
    lengths = rules.select("host", F.length("rule").alias("len")).distinct()
    probes = paths.join(lengths, "host").where(F.length("path") >= F.col("len")).withColumn("rule", F.expr("left(path, len)"))
    hit = probes.join(rules, ["host", "rule"]).groupBy("host", "path").agg(F.max_by("allow", F.struct("len", "allow")).alias("allow"))
    return paths.join(hit, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allow"))
