"""Queries of news snapshots, windows, limits, streams and versions."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quern.catalog.base import DOCS, docs, query, table
from quern.operators import aggregates as A, quality as Q, snapshot as N, windows as W
from quern.sources import writers as K
from quern.streaming import limits as L

SECTIONS = ("en", "fr", "de", "es")


def _rows(spark, sf_dir):
    """News rows: a document's language and its source's parity are its categories."""
    d = docs(spark, sf_dir)
    orders = F.create_map(F.col("language"), (F.col("id") % 17).cast("long"))
    return d.select("id", "sourceId", "title", "date", "url", F.array("language", F.lit("other")).alias("categories"), orders.alias("categoryOrders"))


@query("news_canonical", f"WITH {DOCS} SELECT id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title, language AS categories FROM docs WHERE language IN ('en', 'fr', 'de', 'es')")
def news_canonical(spark, sf_dir):
    return N.canonical(_rows(spark, sf_dir), SECTIONS).select("id", "title", F.array_join("categories", ",").alias("categories"))


@query("topk_section", f"""WITH {DOCS}, one AS (SELECT *, row_number() OVER (PARTITION BY sourceId, language, title ORDER BY date DESC, id % 17, id) AS d FROM docs WHERE language IN ('en', 'fr', 'de', 'es')),
r AS (SELECT *, row_number() OVER (PARTITION BY sourceId, language ORDER BY date DESC, id % 17, id) AS rank, count(*) OVER (PARTITION BY sourceId, language) AS available FROM one WHERE d = 1)
SELECT sourceId, language AS section, id, CAST(rank AS INTEGER) AS rank, available FROM r WHERE rank <= 5""")
def topk_section(spark, sf_dir):
    return N.featured(N.canonical(_rows(spark, sf_dir), SECTIONS), 5).select("sourceId", "section", "id", "rank", "available")


@query("section_quota_ready", f"WITH {DOCS}, h AS (SELECT sourceId, language AS section, least(count(DISTINCT title), 5) AS have FROM docs GROUP BY 1, 2), q AS (SELECT DISTINCT d.sourceId, s.section, 5 AS quota FROM docs d, (SELECT unnest(['en', 'fr', 'de', 'es']) AS section) s) SELECT sourceId, section, quota, coalesce(have, 0) AS have FROM q LEFT JOIN h USING (sourceId, section) WHERE coalesce(have, 0) < quota")
def section_quota_ready(spark, sf_dir):
    rows = N.canonical(_rows(spark, sf_dir), SECTIONS)
    quotas = rows.select("sourceId").distinct().select("sourceId", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"), F.lit(5).alias("quota"))
    return N.ready(N.featured(rows, 5), quotas)


@query("section_pages", f"WITH {DOCS} SELECT sourceId, language, id, CAST(ceil(row_number() OVER (PARTITION BY sourceId, language ORDER BY date DESC, id) / 5.0) AS INTEGER) AS page FROM docs")
def section_pages(spark, sf_dir):
    return W.pages(docs(spark, sf_dir).select("sourceId", "language", "id", "date"), ["sourceId", "language"], [F.desc("date"), F.col("id")]).drop("date")


@query("category_page_rows", f"""WITH {DOCS}, p AS (SELECT language, sourceId, id, row_number() OVER (PARTITION BY sourceId, language ORDER BY date DESC, id) AS k, CAST(ceil(row_number() OVER (PARTITION BY sourceId, language ORDER BY date DESC, id) / 5.0) AS INTEGER) AS page FROM docs),
g AS (SELECT sourceId, language, page, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS items FROM p GROUP BY ALL), s AS (SELECT DISTINCT d.sourceId, l.language FROM docs d, (SELECT unnest(['en', 'fr', 'xx']) AS language) l)
SELECT sourceId, language, coalesce(page, 1) AS page, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM s LEFT JOIN g USING (sourceId, language)""")
def category_page_rows(spark, sf_dir):
    d = docs(spark, sf_dir).select("sourceId", "language", "id", "date", F.col("id").cast("string").alias("item"))
    sections = d.select("sourceId").distinct().select("sourceId", F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("xx"))).alias("language"))
    return K.category_pages(d, sections, ["sourceId", "language"], [F.desc("date"), F.col("id")], "item")


@query("round_robin", f"WITH {DOCS} SELECT id, CAST(turn AS INTEGER) AS turn FROM (SELECT id, sourceId, row_number() OVER (PARTITION BY sourceId ORDER BY date DESC, id) AS turn FROM docs) ORDER BY turn, sourceId LIMIT 48")
def round_robin(spark, sf_dir):
    return W.round_robin(docs(spark, sf_dir).select("id", "sourceId", "date"), "sourceId", [F.desc("date"), F.col("id")], 48).select("id", "turn")


@query("image_numbering", "SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN l_returnflag || ' (' || CAST(i AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ')' ELSE l_returnflag END AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def image_numbering(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return W.numbered(li, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], "l_returnflag").select("l_orderkey", "l_linenumber", "numbered")


@query("media_flatten", """WITH d AS (SELECT doc_id AS id, CAST(doc_id % 4 AS INTEGER) AS n, lang AS title, doc_id % 6 = 0 AS v FROM documents)
SELECT id, 0 AS place, 'article' AS mediaType, title AS shown FROM d UNION ALL SELECT id, k, 'image', CASE WHEN n > 1 THEN title || ' (' || CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ')' ELSE title END FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM d WHERE n > 0) UNION ALL SELECT id, n + 1, 'video', title FROM d WHERE v""")
def media_flatten(spark, sf_dir):
    i = F.col("doc_id")
    images = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(i % 4, F.lit(1))), lambda k: F.concat(F.lit("i"), k.cast("string"))))
    d = table(spark, sf_dir, "documents").select(i.alias("id"), F.col("lang").alias("title"), F.lit("u").alias("url"), images.alias("images"), F.when(i % 6 == 0, F.lit("v")).alias("video"))
    return N.media_rows(d, "images", "video").select("id", "place", "mediaType", "shown")


@query("media_rebuild", "SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS images FROM lineitem GROUP BY 1")
def media_rebuild(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.lit("image").alias("mediaType"), F.col("l_partkey").cast("string").alias("mediaUrl"))
    return N.rebuilt(li).select("id", F.array_join("images", ",").alias("images"))


@query("category_order_merge", "SELECT doc_id AS id, CAST(least(doc_id % 7, doc_id % 5) AS BIGINT) AS a, CAST(doc_id % 3 AS BIGINT) AS b FROM documents")
def category_order_merge(spark, sf_dir):
    i = F.col("doc_id")
    m = A.merged_maps(F.create_map(F.lit("a"), i % 7), F.create_map(F.lit("a"), i % 5, F.lit("b"), i % 3))
    return table(spark, sf_dir, "documents").select(i.alias("id"), m["a"].alias("a"), m["b"].alias("b"))


@query("lag_sorted_check", "SELECT l_orderkey, l_linenumber, l_partkey, before FROM (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) WHERE l_partkey > before")
def lag_sorted_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("place"))
    return W.order_breaks(li, "l_orderkey", "place", "l_partkey").drop("place")


@query("heading_carry", "SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag ROWS UNBOUNDED PRECEDING) AS carried_v FROM lineitem")
def heading_carry(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("v"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("place"))
    return W.carried(li, "l_orderkey", "place", "v").drop("v", "place")


@query("recent_list", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24")
def recent_list(spark, sf_dir):
    return W.recent(table(spark, sf_dir, "events"), "user_id", "ts")


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTES PRECEDING AND CURRENT ROW) AS in_10m, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_24h FROM events")
def rate_limit_window(spark, sf_dir):
    return W.attempts(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", {"in_10m": 600, "in_24h": 86400}).select("event_id", "in_10m", "in_24h")


@query("cooldown_gap", "SELECT event_id, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0) AS BIGINT) AS gap_s FROM events")
def cooldown_gap(spark, sf_dir):
    return W.gaps(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "gap_s")


@query("idempotent_dedupe", "SELECT user_id AS key, arg_min(event_type, event_id) AS payload, count(*) AS sent, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1")
def idempotent_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("payload"), "event_id")
    return L.accepted_once(e, "key", "event_id", "payload")


@query("comment_page", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def comment_page(spark, sf_dir):
    """The newest comments of each article: a keyset page of each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return W.quota(c, ["conv_id"], "turn", [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("future_drop", "SELECT event_id FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-16'")
def future_drop(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.to_date("ts") <= F.date_add(F.lit("2024-01-15").cast("date"), 1)).select("event_id")


@query("version_hash", "SELECT left(sha256(string_agg(h, '' ORDER BY n_nationkey)), 16) AS version FROM (SELECT n_nationkey, sha256(concat_ws(chr(31), CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS h FROM nation)")
def version_hash(spark, sf_dir):
    return Q.version(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("pair_hash_set", "SELECT DISTINCT sha256(source || chr(10) || lang) AS pair FROM documents")
def pair_hash_set(spark, sf_dir):
    from quern.functions.urls import pair_hash

    return table(spark, sf_dir, "documents").select(pair_hash(F.col("source"), F.col("lang")).alias("pair")).distinct()


@query("seed_payload", "SELECT n_nationkey AS id, '{\"id\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\"}' AS payload FROM nation")
def seed_payload(spark, sf_dir):
    return K.seed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, sf_dir):
    """The batch twin of the stream's tumbling windows."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("rate_limit_exact")
def rate_limit_exact(spark, sf_dir):
    """Accepted and refused events: a fold over each user's accepted events, which a window can't say; tests compare with plain Python."""
    return L.replay(table(spark, sf_dir, "events"))


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    """The same through Structured Streaming: events as a file stream, all available batches, into Parquet files."""
    return _streamed(spark, sf_dir, "events", lambda s: L.limiter(s), "rate_limit")


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    counted = lambda s: L.windowed_counts(s, "ts", "event_type", "1 hour", "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    return _streamed(spark, sf_dir, "events", counted, "window_counts", "complete")


def _streamed(spark, sf_dir, name, change, label, mode="append"):
    """Drives a stream over a table's files to its end and returns its rows.  Appended rows, as many as the input's, go to
    Parquet files in the shared folder; a complete result, one row a window and key, to a memory table on the driver."""
    import uuid

    kind = table(spark, sf_dir, name).schema
    sink = f"{label}_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_folder(sf_dir, name))
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quern-stream-")
    folder = f"{base.rstrip('/')}/stream-{sink}"
    rows = change(stream)
    out = rows.writeStream.outputMode(mode).queryName(sink).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        out.format("parquet").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    out.format("memory").start().awaitTermination()
    return spark.table(sink)


def _folder(sf_dir: str, name: str) -> str:
    """A file stream reads folders or globs: a glob that matches the table only, file or folder."""
    return f"{sf_dir}/{name}.parque[t]"
