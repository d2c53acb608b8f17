"""Queries of assets, videos, catalogues and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import DOCS, docs, query, table
from quern.operators import assets as A


def _with_thumbs(spark, sf_dir):
    thumb = F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://img.example.org/"), (F.col("id") % 40).cast("string"), F.lit(".jpg"))).otherwise(F.lit(""))
    return docs(spark, sf_dir).withColumns({"thumbnailUrl": thumb, "cachedThumbnailUrl": F.lit("old"), "cachedUrl": F.lit("")})


_THUMBS = f"{DOCS}, t AS (SELECT *, CASE WHEN id % 3 > 0 THEN 'https://img.example.org/' || CAST(id % 40 AS VARCHAR) || '.jpg' ELSE '' END AS thumb FROM docs)"


@query("asset_candidates", f"WITH {_THUMBS}, c AS (SELECT sourceId, thumb AS asset, 'thumbnailUrl' AS field FROM t WHERE thumb <> '' UNION ALL SELECT sourceId, url, 'url' FROM t WHERE mediaType = 'image') SELECT asset, min(sourceId) AS sourceId, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM c GROUP BY 1")
def asset_candidates(spark, sf_dir):
    return A.candidates(_with_thumbs(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query("asset_mirror", f"WITH {_THUMBS} SELECT id, CASE WHEN thumb <> '' AND (id % 40) % 2 = 0 THEN 'local/' || CAST(id % 40 AS VARCHAR) ELSE 'old' END AS cachedThumbnailUrl FROM t")
def asset_mirror(spark, sf_dir):
    n = F.col("id")
    results = spark.range(40).select(F.concat(F.lit("https://img.example.org/"), n.cast("string"), F.lit(".jpg")).alias("asset"), F.when(n % 2 == 0, F.concat(F.lit("local/"), n.cast("string"))).alias("path"))
    return A.mirrored(_with_thumbs(spark, sf_dir), results).select("id", "cachedThumbnailUrl")


@query("weak_previews", f"WITH {DOCS} SELECT id FROM docs WHERE length(trim(regexp_replace(snippet, '\\s+', ' ', 'g'))) < 80 OR regexp_matches(snippet, '(…|\\.\\.\\.)\\s*$') OR regexp_matches(snippet, '(?i)^(menu|home|skip to|cookie)')")
def weak_previews(spark, sf_dir):
    return docs(spark, sf_dir).where(A.weak_preview(F.col("snippet"))).select("id")


@query("video_contract", """WITH v AS (SELECT 'v' || CAST(event_id % 9000 AS VARCHAR) AS videoId, CAST(user_id AS VARCHAR) AS channelName, CAST(value * 1000 AS BIGINT) % 7 AS publishedAt, event_id AS place, CASE WHEN event_id % 11 = 0 THEN '' ELSE 't' END AS title FROM events)
SELECT videoId, 'repeated' AS fault FROM v GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT videoId, 'order' FROM (SELECT *, lag(publishedAt) OVER w AS p, lag(videoId) OVER w AS i FROM v WINDOW w AS (PARTITION BY channelName ORDER BY place)) WHERE p < publishedAt OR (p = publishedAt AND i > videoId) UNION ALL SELECT videoId, 'title' FROM v WHERE title = ''""")
def video_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return A.video_contract(e.select(F.concat(F.lit("v"), (i % 9000).cast("string")).alias("videoId"), F.col("user_id").cast("string").alias("channelName"), (F.round(F.col("value") * 1000).cast("long") % 7).alias("publishedAt"), i.alias("place"), F.when(i % 11 == 0, "").otherwise("t").alias("title")))


@query("catalogue_filter", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'an') AND (p_brand = 'Brand#1' OR starts_with(p_brand, 'Brand#1-'))")
def catalogue_filter(spark, sf_dir):
    return A.named(table(spark, sf_dir, "part"), ["p_name", "p_type"], " AN ", "Brand#1", "p_brand").select("p_partkey")


@query("news_title_search", f"WITH {DOCS} SELECT id FROM docs WHERE contains(lower(title), 'the') AND contains(lower(title), 'and')")
def news_title_search(spark, sf_dir):
    from quern.plans.language import validate_news_query

    return A.title_search(docs(spark, sf_dir), validate_news_query("The  and")).select("id")


@query("live_scores", f"WITH {DOCS} SELECT id, greatest(CASE WHEN contains(lower(title), 'of the') THEN 5200 WHEN contains(lower(title), 'of') AND contains(lower(title), 'the') THEN 4700 ELSE 0 END, CASE WHEN contains(lower(snippet), 'of the') THEN 3900 WHEN contains(lower(snippet), 'of') AND contains(lower(snippet), 'the') THEN 3400 ELSE 0 END, CASE WHEN contains(lower(body), 'of the') THEN 2400 WHEN contains(lower(body), 'of') AND contains(lower(body), 'the') THEN 2000 ELSE 0 END) AS score FROM docs")
def live_scores(spark, sf_dir):
    return docs(spark, sf_dir).select("id", A.live_score(F.col("title"), F.col("snippet"), F.col("body"), "of the").alias("score"))


@query("error_classes", "SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'blocked' WHEN 2 THEN 'server' WHEN 3 THEN 'network' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def error_classes(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, ("Timed out after 5 s", "HTTP 403", "HTTP 502", "ENOTFOUND a.b", "odd"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type", A.error_class(said).alias("kind")).agg(F.count("*").alias("n"))


@query("category_page_overlay", f"""WITH {DOCS}, p AS (SELECT language AS section, url, date, title FROM docs WHERE id % 3 = 0), l AS (SELECT language AS section, url, date, 'live' AS title FROM docs WHERE id % 2 = 0),
b AS (SELECT section, url, coalesce(l.date, p.date) AS date, coalesce(l.title, p.title) AS title FROM p FULL JOIN l USING (section, url)) SELECT section, url, date, title, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY date DESC, url) AS rank FROM b) WHERE rank <= 5""")
def category_page_overlay(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("language").alias("section"), "url", "date", "title", "id")
    return A.category_page(d.where("id % 2 = 0").withColumn("title", F.lit("live")).drop("id"), d.where("id % 3 = 0").drop("id"))


@query("korean_clock", "SELECT event_id, strftime(ts + INTERVAL 9 HOURS, '%Y%m%d') AS ymd, CAST(hour(ts + INTERVAL 9 HOURS) * 60 + minute(ts + INTERVAL 9 HOURS) AS INTEGER) AS minute FROM events")
def korean_clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in A.korean_clock(F.col("ts")).items()))
