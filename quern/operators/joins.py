"""Joins of documents with sources, originals, stories, media and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_either_key(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source by id, else by name."""
    by_id = sources.select(F.col("id").alias("sourceId"), F.struct("id", "name").alias("_a"))
    by_name = sources.groupBy(F.col("name").alias("sourceName")).agg(F.min(F.struct("id", "name")).alias("_b"))
    out = docs.join(by_id, "sourceId", "left").join(by_name, "sourceName", "left")
    return out.withColumn("source", F.coalesce("_a", "_b")).drop("_a", "_b")


def originals(copies: DataFrame, rows: DataFrame) -> DataFrame:
    """Each copy's original URL by (source, media, date, title), else without the date; the first original of a key wins."""
    full, loose = ["sourceId", "mediaType", "date", "title"], ["sourceId", "mediaType", "title"]
    a = rows.groupBy(*full).agg(F.min_by("url", "id").alias("_exact"))
    b = rows.groupBy(*loose).agg(F.min_by("url", "id").alias("_loose"))
    return copies.join(a, full, "left").join(b, loose, "left").withColumn("originalUrl", F.coalesce("_exact", "_loose", F.lit(""))).drop("_exact", "_loose")


def latest_asset(docs: DataFrame, assets: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """A restored value by keys; the last asset row wins."""
    return docs.join(assets.groupBy(*keys).agg(F.max_by(value, at).alias(value)), keys, "left")


def richer(weak: DataFrame, rich: DataFrame, least: int) -> DataFrame:
    """For each weak document the richer one of the same bucket (media type, day) with the largest score of shared title words: an equi-join on
    (bucket, word), so only documents that share a word meet; words of five characters and more count."""
    words = lambda t: F.filter(F.array_distinct(F.split(F.lower(t), "[^\\p{L}\\p{N}]+")), lambda w: F.length(w) >= 5)
    a = weak.select(F.col("id").alias("weak"), "mediaType", "date", F.explode(words(F.col("title"))).alias("word"))
    b = rich.select(F.col("id").alias("rich"), "mediaType", "date", "quality", F.explode(words(F.col("title"))).alias("word"))
    met = a.join(b, ["mediaType", "date", "word"]).where("weak <> rich").groupBy("weak", "rich").agg(F.count("*").alias("shared"), F.max("quality").alias("quality")).where(F.col("shared") >= least)
    return met.groupBy("weak").agg(F.max_by("rich", F.struct("shared", "quality", -F.col("rich"))).alias("rich"), F.max("shared").alias("shared"))


def media_of(articles: DataFrame, media: DataFrame) -> DataFrame:
    """Media of an article by its id or URL, each once, in order."""
    a = articles.select(F.col("id").alias("article")).join(media.select(F.col("articleId").alias("article"), "mediaId", "place"), "article")
    b = articles.select(F.col("id").alias("article"), F.col("url").alias("articleUrl")).join(media.select("articleUrl", "mediaId", "place"), "articleUrl").drop("articleUrl")
    both = a.unionByName(b).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "mediaId"))), lambda m: m["mediaId"])
    return both.groupBy("article").agg(ordered.alias("media"))


def dangling(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Children whose parent is missing; a null or empty reference is none."""
    known = parents.select(F.col(parent).alias("_p")).distinct()
    return children.where(F.coalesce(F.col(child).cast("string"), F.lit("")) != "").join(known, F.col(child) == F.col("_p"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, longer: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """A full outer join by key: new values win, but the longer text of `longer`, and the old values of `keep`."""
    names = [c for c in old.columns if c != key]
    a, b = (df.select(key, F.struct(*names).alias(s)) for df, s in ((old, "_o"), (new, "_n")))

    def pick(c: str) -> Column:
        o, n = F.col("_o").getField(c), F.col("_n").getField(c)
        if c in longer:
            return F.when(F.length(F.coalesce(n, F.lit(""))) >= F.length(F.coalesce(o, F.lit(""))), n).otherwise(o)
        return F.coalesce(o, n) if c in keep else F.coalesce(n, o)

    return a.join(b, key, "full").select(key, *(pick(c).alias(c) for c in names))


def confirmed(existing: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Existing rows confirmed by id, or by an identity that is unique on both sides."""
    by_id = existing.join(incoming.select("id").distinct(), "id", "left_semi")
    unique = lambda df: df.groupBy(*identity).agg(F.count("*").alias("_c")).where("_c = 1").select(*identity)
    both = unique(existing).join(unique(incoming), identity)
    return by_id.unionByName(existing.join(both, identity, "left_semi").join(by_id.select("id"), "id", "left_anti"))


def overlay(live: DataFrame, published: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """Live rows refreshed from the published ones, then published rows that are not live; capped by day and title."""
    names = [c for c in live.columns if c != key]
    known = published.select(key, F.struct(*names).alias("_p"))
    fresh = live.join(known, key, "left").select(key, *(F.coalesce(F.col(c), F.col("_p").getField(c)).alias(c) for c in names), F.lit("live").alias("origin"))
    rest = published.join(live.select(key), key, "left_anti").select(key, *names, F.lit("published").alias("origin"))
    out = fresh.unionByName(rest)
    return out.orderBy(F.desc("date"), "title", key).limit(cap) if cap else out


def by_precedence(base: DataFrame, key: str, value: str, *parts: DataFrame) -> DataFrame:
    """A value from the first part that has one."""
    for k, p in enumerate(parts):
        base = base.join(p.select(key, F.col(value).alias(f"_v{k}")), key, "left")
    return base.withColumn(value, F.coalesce(*(F.col(f"_v{k}") for k in range(len(parts))))).drop(*(f"_v{k}" for k in range(len(parts))))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, right_id: str) -> DataFrame:
    """For each left row the last right value at or before it: a union and one window pass per key, not a range join."""
    a = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType), "_tie": F.lit(0).cast("long")})
    b = right.select(*keys, at, F.col(value).alias("_value"), F.col(right_id).cast("long").alias("_tie"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value", "_tie")
