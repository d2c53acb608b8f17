"""Queries of scans, contracts, de-duplication, joins and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import DOCS, SOURCES, docs, query, sources, table
from quern.functions import text as T, urls
from quern.operators import aggregates as A, dedupe as D, joins as J, quality as Q
from quern.sources import readers as R, writers as K

LANGS = ("en", "fr", "de")


@query("page_links", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 1) - 1 AS place FROM pages)
SELECT page_id, CAST(place AS INTEGER) AS place, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS label FROM a""")
def page_links(spark, sf_dir):
    return R.anchors(table(spark, sf_dir, "pages"), "page_id", "html")


@query("page_extract", r"""SELECT page_id, CASE WHEN h <> '' THEN h ELSE t END AS title, regexp_extract(html, '(?i)<html[^>]*\slang="([a-z-]+)"', 1) AS language, CAST(len(regexp_extract_all(html, '(?i)<p[\s>]')) AS INTEGER) AS paragraphs
FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS h, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def page_extract(spark, sf_dir):
    return R.page_details(table(spark, sf_dir, "pages"), "page_id", "html")


@query("markdown_links", "SELECT doc_id AS id, CAST(2 AS BIGINT) AS line, 'L' || CAST(doc_id AS VARCHAR) AS label, 'http://a.example.org/' || CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '2023-5-6' END AS date FROM documents")
def markdown_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    link = F.concat(F.lit("[L"), F.col("id").cast("string"), F.lit("](http://a.example.org/"), F.col("id").cast("string"), F.lit(")"))
    lines = F.array(F.lit("intro"), F.lit("posted 2023-5-6"), F.when(F.col("id") % 2 == 0, F.concat(link, F.lit(" 2024-01-02"))).otherwise(link))
    return R.markdown_links(d.select("id", F.posexplode(lines).alias("line", "value")).withColumn("line", F.col("line").cast("long")), "id", "line")


@query("markdown_table", "SELECT doc_id AS id, source AS a, 'x|y' AS b FROM documents")
def markdown_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("| --- | --- |"), F.concat(F.lit("| "), F.col("source"), F.lit(" | x\\|y |")), F.lit("| one cell |"))).alias("value"))
    return R.markdown_table(d, 2).select("id", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("playlist_shapes", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 3 THEN '' ELSE 'T' || CAST(doc_id AS VARCHAR) END AS title, CAST(CASE doc_id % 4 WHEN 3 THEN 0 ELSE 2 END AS INTEGER) AS tracks FROM documents")
def playlist_shapes(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    one = F.concat(F.lit('[{"title":"T'), i, F.lit('","cover":"c","ids":["a","b"]}]'))
    raw = F.when(F.col("doc_id") % 4 == 0, one).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"items":'), one, F.lit("}"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("T"), i, F.lit("@c@a,b"))).otherwise(F.lit("<html>a@b@c</html>"))
    p = R.playlists(raw)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.get(p, F.lit(0))["title"], F.lit("")).alias("title"), F.coalesce(F.size(F.get(p, F.lit(0))["ids"]), F.lit(0)).alias("tracks"))


@query("robots_decide", "SELECT DISTINCT 'h' || CAST(doc_id % 7 AS VARCHAR) AS host, '/' || lang || '/' || source AS path, lang NOT IN ('fr') OR source IN ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') AS allow FROM documents")
def robots_decide(spark, sf_dir):
    host = F.concat(F.lit("h"), (F.col("doc_id") % 7).cast("string"))
    paths = table(spark, sf_dir, "documents").select(host.alias("host"), F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("source")).alias("path")).distinct()
    text = F.array(*map(F.lit, ("User-agent: other", "Disallow: /", "User-agent: *", "Disallow: /fr", "Allow: /fr/src1 # kept", "Disallow: ")))
    lines = spark.range(7).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.posexplode(text).alias("line", "value"))
    return Q.robots(R.robots_rules(lines, "host", "line"), paths)


@query("crawl_frontier", "WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS n, 0 AS depth UNION SELECT n * 2 + k, depth + 1 FROM r, (SELECT unnest([0, 1]) AS k) WHERE depth < 4 AND n * 2 + k <= (SELECT count(*) FROM documents)) SELECT 'u' || CAST(n AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY n")
def crawl_frontier(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("n")).where("n > 1")
    links = d.select(F.concat(F.lit("u"), F.floor(F.col("n") / 2).cast("string")).alias("url"), F.concat(F.lit("u"), F.col("n").cast("string")).alias("target"))
    return R.frontier(links, ["u1"], 4)


@query("wordpress_posts", "SELECT doc_id AS id, 'P' || CAST(doc_id AS VARCHAR) AS title FROM documents")
def wordpress_posts(spark, sf_dir):
    raw = F.concat(F.lit('noise [{"id":'), F.col("doc_id").cast("string"), F.lit(',"link":"u","title":{"rendered":"P'), F.col("doc_id").cast("string"), F.lit('"}}] more'))
    return table(spark, sf_dir, "documents").select(F.explode(R.wordpress(raw)).alias("p")).select("p.id", F.col("p.title.rendered").alias("title"))


@query("contract_pk", "SELECT source AS sourceId, doc_id % 100 AS slot, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def contract_pk(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "documents").select(F.col("source").alias("sourceId"), (F.col("doc_id") % 100).alias("slot")), "sourceId", "slot")


@query("contract_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def contract_fk(spark, sf_dir):
    return J.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_custkey % 3 > 0"), "o_custkey", "c_custkey")


@query("contract_row_errors", f"WITH {DOCS} SELECT id, concat_ws(',', CASE WHEN title = '' THEN 'title:required' END, CASE WHEN language NOT IN ('en', 'fr', 'de') THEN 'language:enum' END) AS errors FROM docs WHERE title = '' OR language NOT IN ('en', 'fr', 'de')")
def contract_row_errors(spark, sf_dir):
    errors = Q.row_errors(Q.document_checks(LANGS, ("article", "pdf", "image", "video", "broadcast")))
    return docs(spark, sf_dir).select("id", F.concat_ws(",", errors).alias("errors")).where("errors <> ''")


@query("contract_host_policy", f"WITH {DOCS} SELECT id FROM docs WHERE sourceId = 'src3'")
def contract_host_policy(spark, sf_dir):
    odd = sources(spark, sf_dir).withColumn("host", F.when(F.col("id") == "src3", F.lit("elsewhere.example.org")).otherwise(F.lit("example.org")))
    return Q.host_policy(docs(spark, sf_dir), odd).select("id")


@query("contract_unknown_keys", "SELECT event_id, 'extra' AS unknown FROM events WHERE event_id % 3 = 0")
def contract_unknown_keys(spark, sf_dir):
    json = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": 1, "extra": 2}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(Q.unknown_keys(json, ("k",)), ",").alias("unknown")).where("unknown <> ''")


@query("set_difference", "SELECT n_nationkey, 'missing' AS side FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_nationkey + 100, 'unexpected' FROM nation WHERE n_nationkey % 5 = 0")
def set_difference(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return D.differences(n, n.where("n_nationkey % 2 = 0").unionByName(n.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"))))


@query("dedupe_best_by_id", "SELECT o_custkey AS id, o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_best_by_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    return D.best_of(o, ["id"], F.col("o_totalprice"), -F.col("o_orderkey")).select("id", "o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("price"))


@query("dedupe_story", f"""WITH {DOCS}, k AS (SELECT id, date, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS story, length(body) AS quality FROM docs)
SELECT id, quality FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY quality DESC, date DESC, id) AS n FROM k) WHERE n = 1""")
def dedupe_story(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("place", F.col("id"))
    return D.stories(d, T.story_text_plain(F.col("title")), F.length("body")).select("id", F.length("body").cast("long").alias("quality"))


@query("dedupe_last_wins", "SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS place FROM orders GROUP BY 1")
def dedupe_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return D.last_wins(o, ["id"], "o_orderkey")


@query("dedupe_first_either_key", "WITH a AS (SELECT * FROM (SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1) SELECT l_partkey, l_suppkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos) AS m FROM a) WHERE m = 1")
def dedupe_first_either_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return D.first_by_either(li, "l_partkey", "l_suppkey", "pos")


@query("dedupe_conflicts", "SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def dedupe_conflicts(spark, sf_dir):
    return D.conflicts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus"), "id")


@query("dedupe_merge", "SELECT source AS id, max(length(text)) AS longest, string_agg(DISTINCT lang, ',' ORDER BY lang) AS categories FROM documents GROUP BY 1")
def dedupe_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("text").alias("body"), F.array("lang").alias("categories"))
    return D.merged(d, ["id"]).select("id", F.length("body").cast("long").alias("longest"), F.array_join("categories", ",").alias("categories"))


@query("dedupe_capped_insert", "SELECT source AS url, min(doc_id) AS place, string_agg(DISTINCT lang, ',' ORDER BY lang) AS tags FROM documents GROUP BY 1 ORDER BY 2, 1 LIMIT 12")
def dedupe_capped_insert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("lang").alias("tag"), F.col("doc_id").alias("at"))
    return D.capped_insert(d, "url", "at", 12).select("url", "place", F.array_join("tags", ",").alias("tags"))


@query("union_replace_source", f"""WITH {DOCS}, new AS (SELECT id + 1000000 AS id, sourceId FROM docs WHERE sourceId < 'src15' UNION ALL SELECT id + 2000000, sourceId FROM docs WHERE sourceId < 'src12' AND language = 'en'),
take AS (SELECT n.sourceId FROM (SELECT sourceId, count(*) AS c FROM new WHERE NOT (sourceId = 'src10' AND id % 2 = 0) GROUP BY 1) n LEFT JOIN (SELECT sourceId, count(*) AS c FROM docs GROUP BY 1) o USING (sourceId) WHERE n.c >= coalesce(o.c, 0))
SELECT id, sourceId FROM docs WHERE sourceId NOT IN (SELECT sourceId FROM take) UNION ALL SELECT id, sourceId FROM new WHERE NOT (sourceId = 'src10' AND id % 2 = 0) AND sourceId IN (SELECT sourceId FROM take)""")
def union_replace_source(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", "sourceId", "language")
    new = d.where("sourceId < 'src15'").withColumn("id", F.col("id") + 1000000).unionByName(d.where("sourceId < 'src12' AND language = 'en'").withColumn("id", F.col("id") + 2000000))
    new = new.where("NOT (sourceId = 'src10' AND id % 2 = 0)").select("id", "sourceId")
    return D.replace_sources(d.select("id", "sourceId"), new)


@query("join_source_or_key", f"WITH {DOCS}, {SOURCES} SELECT d.id, CASE WHEN d.id % 3 < 2 THEN s.name END AS name FROM docs d JOIN sources s ON s.id = d.sourceId")
def join_source_or_key(spark, sf_dir):
    d = docs(spark, sf_dir)
    keyed = d.select("id", F.when(F.col("id") % 3 == 0, F.col("sourceId")).otherwise(F.lit("?")).alias("sourceId"), F.when(F.col("id") % 3 == 1, F.col("sourceName")).otherwise(F.lit("?")).alias("sourceName"))
    return J.by_either_key(keyed, sources(spark, sf_dir)).select("id", F.col("source.name").alias("name"))


@query("join_original_fallback", f"""WITH {DOCS}, o AS (SELECT * FROM docs WHERE id % 2 = 0),
a AS (SELECT sourceId, mediaType, date, title, arg_min(url, id) AS u FROM o GROUP BY ALL), b AS (SELECT sourceId, mediaType, title, arg_min(url, id) AS u FROM o GROUP BY ALL)
SELECT d.id, coalesce(a.u, b.u, '') AS originalUrl FROM docs d LEFT JOIN a USING (sourceId, mediaType, date, title) LEFT JOIN b ON b.sourceId = d.sourceId AND b.mediaType = d.mediaType AND b.title = d.title""")
def join_original_fallback(spark, sf_dir):
    d = docs(spark, sf_dir)
    return J.originals(d.drop("url"), d.where("id % 2 = 0")).select("id", "originalUrl")


@query("join_cached_assets", "SELECT doc_id AS id, CAST(b.v AS VARCHAR) AS asset FROM documents LEFT JOIN (SELECT lang, source, max(doc_id) AS v FROM documents WHERE doc_id % 4 = 0 GROUP BY ALL) b USING (lang, source)")
def join_cached_assets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    assets = d.where("id % 4 = 0").select("lang", "source", F.col("id").cast("string").alias("asset"), F.col("id").alias("at"))
    return J.latest_asset(d, assets, ["lang", "source"], "at", "asset").select("id", "asset")


@query("join_same_story", f"""WITH {DOCS}, w AS (SELECT DISTINCT id, mediaType, date, length(body) AS quality, unnest(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM docs),
m AS (SELECT a.id AS weak, b.id AS rich, count(*) AS shared, max(b.quality) AS quality FROM w a JOIN w b USING (mediaType, date, word) WHERE length(word) >= 5 AND a.quality < 1000 AND b.quality >= 1000 GROUP BY 1, 2)
SELECT weak, rich, shared FROM (SELECT *, row_number() OVER (PARTITION BY weak ORDER BY shared DESC, quality DESC, rich) AS n FROM m) WHERE n = 1""")
def join_same_story(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("quality", F.length("body"))
    return J.richer(d.where("quality < 1000"), d.where("quality >= 1000"), 1)


@query("join_media_assoc", "SELECT o_orderkey AS article, string_agg(CAST(m AS VARCHAR), ',' ORDER BY p, m) AS media FROM (SELECT DISTINCT o_orderkey, l_partkey AS m, l_linenumber AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0 OR l_linenumber % 3 > 0) GROUP BY 1")
def join_media_assoc(spark, sf_dir):
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    li = table(spark, sf_dir, "lineitem")
    media = li.select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("articleId"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("u"), F.col("l_orderkey").cast("string"))).alias("articleUrl"), F.col("l_partkey").alias("mediaId"), F.col("l_linenumber").alias("place"))
    media = media.where("articleId IS NOT NULL OR articleUrl IS NOT NULL")
    return J.media_of(articles, media).select("article", F.array_join(F.transform("media", lambda m: m.cast("string")), ",").alias("media"))


@query("join_dangling_anti", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def join_dangling_anti(spark, sf_dir):
    return J.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part").where("p_size > 10"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("join_semi_has_media", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi_has_media(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("join_confirmed_semi", """WITH e AS (SELECT o_orderkey AS id, o_custkey AS c, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 100000000 END AS id, o_custkey AS c, o_totalprice AS p FROM orders WHERE o_orderkey % 3 = 0)
SELECT id FROM e WHERE id IN (SELECT id FROM i) OR (c, p) IN (SELECT (c, p) FROM (SELECT c, p FROM e GROUP BY 1, 2 HAVING count(*) = 1) JOIN (SELECT c, p FROM i GROUP BY 1, 2 HAVING count(*) = 1) USING (c, p))""")
def join_confirmed_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    new = o.where("id % 3 = 0").withColumn("id", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("id") + 100000000))
    return J.confirmed(o.where("id % 2 = 0"), new, ["c", "p"]).select("id")


@query("join_asof_programme", """SELECT l.event_id, r.event_id AS programme FROM (SELECT * FROM events WHERE event_type <> 'click') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof_programme(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("programme"))
    return J.as_of(e.where("event_type <> 'click'").drop("event_type"), right, ["user_id"], "ts", "programme", "programme").select("event_id", "programme")


@query("merge_upsert", """WITH o AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS body FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, upper(c_name) AS title, left(c_mktsegment, CAST(c_custkey % 12 AS INTEGER)) AS body FROM customer WHERE c_custkey % 2 = 0)
SELECT id, coalesce(n.title, o.title) AS title, CASE WHEN length(coalesce(n.body, '')) >= length(coalesce(o.body, '')) THEN n.body ELSE o.body END AS body FROM o FULL JOIN n USING (id)""")
def merge_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("title"), F.left("c_mktsegment", (F.col("c_custkey") % 12).cast("int")).alias("body"))
    return J.upsert(old, new, "id", longer=("body",))


@query("merge_overlay", """WITH live AS (SELECT doc_id AS url, 'L' AS title, CAST(doc_id % 28 AS VARCHAR) AS date FROM documents WHERE doc_id % 5 = 0), pub AS (SELECT doc_id AS url, lang AS title, CAST(doc_id % 28 AS VARCHAR) AS date FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM (SELECT url, title, date, 'live' AS origin FROM live UNION ALL SELECT url, title, date, 'published' FROM pub WHERE url NOT IN (SELECT url FROM live)) ORDER BY date DESC, title, url LIMIT 256""")
def merge_overlay(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("lang").alias("title"), (F.col("doc_id") % 28).cast("string").alias("date"))
    return J.overlay(d.where("url % 5 = 0").withColumn("title", F.lit("L")), d.where("url % 2 = 0"), "url", 256)


@query("merge_multiway_precedence", "SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'rss' END, CASE WHEN doc_id % 3 = 0 THEN 'title' END, CASE WHEN doc_id % 2 = 0 THEN 'previous' END) AS day FROM documents")
def merge_multiway_precedence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    part = lambda n, v: d.where(f"id % {n} = 0").withColumn("day", F.lit(v))
    return J.by_precedence(d, "id", "day", part(5, "rss"), part(3, "title"), part(2, "previous"))


@query("shard_index", None)
def shard_index(spark, sf_dir):
    """All 256 shards with their rows, empty ones too."""
    return K.shard_index(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), "id")


@query("incremental_work", "SELECT doc_id AS key FROM documents WHERE doc_id % 10 = 0")
def incremental_work(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("size"))
    return K.work_list(d, d.withColumn("size", F.when(F.col("key") % 10 == 0, -1).otherwise(F.col("size"))), ["size"]).select("key")


@query("lang_undeclared", f"WITH {DOCS} SELECT sourceId, string_agg(DISTINCT language, ',' ORDER BY language) AS undeclared FROM docs WHERE language NOT IN ('en', 'fr') GROUP BY 1")
def lang_undeclared(spark, sf_dir):
    seen = docs(spark, sf_dir).groupBy("sourceId").agg(F.collect_set("language").alias("l"))
    return seen.select("sourceId", F.array_join(F.array_sort(F.array_except("l", F.array(F.lit("en"), F.lit("fr")))), ",").alias("undeclared")).where("undeclared <> ''")


@query("head_regression", f"WITH {DOCS} SELECT sourceId, was, now FROM (SELECT sourceId, max(date) AS was, max(CASE WHEN id % 7 > 0 THEN date END) AS now FROM docs GROUP BY 1) WHERE now < was")
def head_regression(spark, sf_dir):
    d = docs(spark, sf_dir)
    return Q.regressed(d, d.where("id % 7 > 0"))


@query("freshness_guard", f"WITH {DOCS} SELECT sourceId, max(date) AS newest FROM docs WHERE date < '2024-12-01' GROUP BY 1 HAVING date_diff('day', CAST(max(date) AS DATE), DATE '2024-12-10') > 12")
def freshness_guard(spark, sf_dir):
    return Q.stale(docs(spark, sf_dir).where("date < '2024-12-01'"), "2024-12-10", 12)


@query("health_summary", f"""WITH {DOCS}, {SOURCES}, c AS (SELECT sourceId, count(*) AS n, max(date) AS newest FROM docs WHERE sourceId <> 'src4' AND (sourceId <> 'src5' OR date < '2024-06-01') GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'empty' WHEN date_diff('day', CAST(newest AS DATE), DATE '2025-01-01') > 60 THEN 'stale' ELSE 'healthy' END AS status, count(*) AS n FROM sources LEFT JOIN c ON sourceId = id GROUP BY 1""")
def health_summary(spark, sf_dir):
    d = docs(spark, sf_dir).where("sourceId <> 'src4' AND (sourceId <> 'src5' OR date < '2024-06-01')")
    return Q.health(sources(spark, sf_dir), d, "2025-01-01", 60).groupBy("status").agg(F.count("*").alias("n"))


@query("coverage_rollup", "SELECT source, count(*) AS total, count_if(lang = 'en') AS english, count_if(length(text) < 80) AS short, count_if(contains(text, '@')) AS mail FROM documents GROUP BY ROLLUP (source)")
def coverage_rollup(spark, sf_dir):
    return A.coverage(table(spark, sf_dir, "documents"), "source", {"english": F.col("lang") == "en", "short": F.length("text") < 80, "mail": F.contains("text", F.lit("@"))})


@query("failure_grouping_sets", "SELECT user_id % 10 AS src, CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS err, count(*) AS n, CASE WHEN grouping(user_id % 10) = 0 THEN count(DISTINCT CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END) ELSE count(DISTINCT user_id % 10) END AS others, min(event_id) AS sample, CAST(grouping(src) AS INTEGER) AS by_b FROM events GROUP BY GROUPING SETS ((user_id % 10), (CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END))".replace("grouping(src)", "grouping(user_id % 10)"))
def failure_grouping_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("src"), F.when(F.col("event_type") == "click", "a").otherwise("b").alias("err"), "event_id")
    return A.failures(e, "src", "err", "event_id")


@query("coverage_assertions", f"WITH {DOCS} SELECT mediaType, count(*) AS total, count(DISTINCT sourceId) AS sources, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, min(length(body)) AS shortest, count(*) >= 20 AND count(DISTINCT sourceId) >= 5 AS ok FROM docs GROUP BY 1")
def coverage_assertions(spark, sf_dir):
    return A.assertion(docs(spark, sf_dir), "mediaType", 20, 5, F.col("body"))


@query("archive_compaction", f"WITH {DOCS} SELECT date, mediaType, min(id) AS id, count(*) AS copies, string_agg(DISTINCT sourceId, ',' ORDER BY sourceId) AS origins FROM docs GROUP BY 1, 2")
def archive_compaction(spark, sf_dir):
    return A.compacted(docs(spark, sf_dir).withColumn("origin", F.col("sourceId")), ["date", "mediaType"])


@query("channel_counts", "SELECT n_name AS channel, CAST(count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def channel_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("channel"))
    counts = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("channel").agg(F.count("*").alias("n"))
    return A.with_zeros(counts, n.select("channel"))


@query("contamination_guard", "SELECT string_agg(g, chr(10) ORDER BY g) AS imageSet, titles FROM (SELECT k, CAST(k AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS g, titles FROM (SELECT doc_id % 50 AS k, count(DISTINCT doc_id) AS titles FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2), (SELECT unnest(generate_series(1, 8)) AS j)) GROUP BY k, titles")
def contamination_guard(spark, sf_dir):
    """Image sets that stand under several titles."""
    images = F.transform(F.sequence(F.lit(8), F.lit(1)), lambda j: F.concat_ws("-", (F.col("doc_id") % 50).cast("string"), j.cast("string")))
    return Q.contaminated_images(table(spark, sf_dir, "documents").select(images.alias("images"), F.col("doc_id").cast("string").alias("title"), F.lit("2024-01-01").alias("date")))
