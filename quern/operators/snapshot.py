"""News snapshots: canonical rows, sections, media rows, featured lists, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as T
from quern.operators.windows import quota


def categories(c: Column, allowed: tuple[str, ...]) -> Column:
    """Distinct allowed categories in their canonical order."""
    return F.filter(F.array(*map(F.lit, allowed)), lambda x: F.array_contains(c, x))


def orders(m: Column, allowed: tuple[str, ...]) -> Column:
    """Entries of allowed categories with whole numbers from 0."""
    return F.map_filter(m, lambda k, v: k.isin(*allowed) & (v >= 0))


def canonical(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({"title": T.trimmed(F.col("title")), "categories": categories(F.col("categories"), allowed)}).where(F.size("categories") > 0)


def media_rows(rows: DataFrame, images: str = "images", video: str | None = None) -> DataFrame:
    """An article and its image rows with (i/n) titles, and a video row where there is one."""
    n = F.size(images)
    pictures = F.transform(F.col(images), lambda u, i: F.struct(F.lit("image").alias("mediaType"), u.alias("mediaUrl"), F.when(n > 1, F.concat(F.col("title"), F.lit(" ("), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("shown")))
    own = F.array(F.struct(F.lit("article").alias("mediaType"), F.col("url").alias("mediaUrl"), F.col("title").alias("shown")))
    parts = [own, pictures]
    if video:
        parts.append(F.array_compact(F.array(F.when(F.coalesce(F.col(video), F.lit("")) != "", F.struct(F.lit("video").alias("mediaType"), F.col(video).alias("mediaUrl"), F.col("title").alias("shown"))))))
    return rows.select("id", F.posexplode(F.concat(*parts)).alias("place", "m")).select("id", "place", "m.mediaType", "m.mediaUrl", "m.shown")


def rebuilt(media: DataFrame) -> DataFrame:
    """Images of each article again, in order: the inverse of media_rows."""
    return media.where("mediaType = 'image'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mediaUrl"))), lambda x: x["mediaUrl"]).alias("images"))


def featured(rows: DataFrame, k: int) -> DataFrame:
    """The first k of each source and section: newest, then section order, then id; titles once."""
    flat = rows.select("id", "sourceId", "title", "date", F.explode("categories").alias("section"), "categoryOrders")
    place = F.coalesce(F.element_at("categoryOrders", F.col("section")), F.lit(1 << 30))
    return quota(flat.withColumn("place", place), ["sourceId", "section"], "title", [F.desc("date"), F.col("place"), F.col("id")], k)


def ready(featured_rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Sections that lack rows for their quota."""
    have = featured_rows.groupBy("sourceId", "section").agg(F.count("*").alias("have"))
    return quotas.join(have, ["sourceId", "section"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
