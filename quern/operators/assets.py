"""Assets of documents, video tables, catalogues and small classifications."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import text as T

#: Document column -> column that holds its mirrored copy.
TARGETS = {"thumbnailUrl": "cachedThumbnailUrl", "url": "cachedUrl"}


def candidates(docs: DataFrame) -> DataFrame:
    """Assets to mirror: a thumbnail, and the URL itself of images; each URL once, with the columns it serves."""
    ok = lambda c: F.col(c).rlike("^https?://")
    wanted = F.array_compact(F.array(F.when(ok("thumbnailUrl"), F.struct(F.col("thumbnailUrl").alias("asset"), F.lit("thumbnailUrl").alias("field"))), F.when(ok("url") & (F.col("mediaType") == "image"), F.struct(F.col("url").alias("asset"), F.lit("url").alias("field")))))
    return docs.select("sourceId", F.explode(wanted).alias("c")).groupBy("c.asset").agg(F.min("sourceId").alias("sourceId"), F.array_sort(F.collect_set("c.field")).alias("fields"))


def mirrored(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with the copies that exist (asset, path); a failed fetch keeps what was there."""
    for source, target in TARGETS.items():
        found = results.where("path IS NOT NULL").select(F.col("asset").alias(source), F.col("path").alias("_path"))
        docs = docs.join(found, source, "left").withColumn(target, T.first_filled(F.col("_path"), F.col(target))).drop("_path")
    return docs


def weak_preview(c: Column) -> Column:
    """Previews to enrich: short, cut off, or navigation."""
    t = F.coalesce(c, F.lit(""))
    return (F.length(T.squeezed(t)) < 80) | t.rlike("(?:…|\\.\\.\\.)\\s*$") | t.rlike("(?i)^(?:menu|home|skip to|cookie)")


def video_contract(videos: DataFrame) -> DataFrame:
    """Violations of a video table: repeated ids, rows out of order (newest first, then id), missing fields."""
    repeated = videos.groupBy("videoId").agg(F.count("*").alias("_n")).where("_n > 1").select("videoId", F.lit("repeated").alias("fault"))
    w = Window.partitionBy("channelName").orderBy("place")
    before = F.lag(F.struct("publishedAt", F.col("videoId"))).over(w)
    order = videos.withColumn("_b", before).where((F.col("_b.publishedAt") < F.col("publishedAt")) | ((F.col("_b.publishedAt") == F.col("publishedAt")) & (F.col("_b.videoId") > F.col("videoId")))).select("videoId", F.lit("order").alias("fault"))
    missing = videos.where(F.coalesce("title", F.lit("")) == "").select("videoId", F.lit("title").alias("fault"))
    return repeated.unionByName(order).unionByName(missing)


def named(df: DataFrame, columns: list[str], text: str, series: str = "all", column: str = "series") -> DataFrame:
    """A catalogue's rows by a substring of their names and by series: exact, or the beginning up to a dash."""
    hit = F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower())
    return df.where(hit & (F.lit(series == "all") | (F.col(column) == series) | F.col(column).startswith(series + "-")))


def title_search(df: DataFrame, tokens: list[str], title: str = "title") -> DataFrame:
    """Rows whose normalised title holds every token."""
    t = F.lower(T.squeezed(F.col(title)))
    return df.where(reduce(and_, (t.contains(x) for x in tokens), F.lit(True)))


def live_score(title: Column, snippet: Column, body: Column, phrase: str, image: bool = False, extra: Column | None = None) -> Column:
    """Scores of live results: (phrase, all words) of title, snippet and body; images by caption, title and body, with a bonus for focus."""
    # Fixed values.
    table = ((title, 6800, 6300), (snippet, 5900, 5500), (body, 1900, 1600)) if image else ((title, 5200, 4700), (snippet, 3900, 3400), (body, 2400, 2000))
    words = phrase.lower().split()
    scores = []
    for c, whole, parts in table:
        low = F.lower(F.coalesce(c, F.lit("")))
        scores.append(F.when(low.contains(phrase.lower()), whole).when(reduce(and_, (low.contains(w) for w in words), F.lit(True)), parts).otherwise(0))
    best = F.greatest(*scores)
    if not image:
        return best
    return F.when(best > 0, best + F.greatest(F.lit(0), 500 - 15 * F.coalesce(extra if extra is not None else F.lit(0), F.lit(0)))).otherwise(0)


def error_class(message: Column) -> Column:
    """Kinds of crawl errors."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("timed? ?out|deadline|abort"), "timeout").when(m.rlike("\\b40[134]\\b|forbidden|robots"), "blocked").when(m.rlike("\\b5\\d\\d\\b|bad gateway"), "server").when(m.rlike("dns|enotfound|econn|socket"), "network").otherwise("other")


def category_page(live: DataFrame, published: DataFrame, cap: int = 5) -> DataFrame:
    """A category's first page: live rows not yet archived, over published rows refreshed by URL; newest first, `cap` a section."""
    names = [c for c in published.columns if c not in ("url", "section")]
    known = live.select("section", "url", F.struct(*names).alias("_l"))
    refreshed = published.join(known, ["section", "url"], "left").select("section", "url", *(F.coalesce(F.col("_l").getField(c), F.col(c)).alias(c) for c in names))
    fresh = live.join(published.select("section", "url"), ["section", "url"], "left_anti").select("section", "url", *names)
    both = refreshed.unionByName(fresh)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("date"), "url"))).where(F.col("rank") <= cap)


def korean_clock(ts: Column) -> dict[str, Column]:
    """Day and minutes of the Korean wall clock of a UTC timestamp."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Seoul")
    return {"ymd": F.date_format(local, "yyyyMMdd"), "minute": F.hour(local) * 60 + F.minute(local)}
