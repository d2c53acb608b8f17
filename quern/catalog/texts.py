"""Queries of text, date, URL and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import DOCS, docs, query, table
from quern.catalog.search import _SPACES, _compact, _simple
from quern.functions import dates, schema, text as T, urls
from quern.operators import windows as W


@query("text_compact", f"WITH {DOCS} SELECT id, {_compact('snippet')} AS compact, {_simple('snippet')} AS simplified FROM docs")
def text_compact(spark, sf_dir):
    t = T.token(F.col("snippet"))
    return docs(spark, sf_dir).select("id", t["compactLower"].alias("compact"), t["lower"].alias("simplified"))


@query("text_width", "SELECT doc_id AS id, translate(translate(text, 'abcdefgh', 'ａｂｃｄｅｆｇｈ'), 'ａｂｃｄｅｆｇｈ', 'abcdefgh') AS plain FROM documents")
def text_width(spark, sf_dir):
    wide = F.translate("text", "abcdefgh", "ａｂｃｄｅｆｇｈ")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.width(wide).alias("plain"))


@query("text_slug", "SELECT doc_id AS id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def text_slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.slug(F.col("text")).alias("slug"))


@query("text_ngrams", f"""WITH {DOCS}, t AS (SELECT id, {_simple('title')} AS s FROM docs),
g AS (SELECT id, [substr(s, k, n) FOR k IN generate_series(1, length(s) - n + 1)] AS a, n FROM t, (SELECT unnest([2, 3, 4]) AS n))
SELECT id, array_to_string(flatten(list(a ORDER BY n))[1:240], ' ') AS grams FROM g GROUP BY id""")
def text_ngrams(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.array_join(T.ngrams(T.token(F.col("title"))["lower"]), " ").alias("grams"))


@query("text_jamo", "SELECT doc_id AS id, 'ㄱㅏㄴㅏx' || CAST(doc_id AS VARCHAR) || 'ㄷㅏㄺ' AS jamo FROM documents")
def text_jamo(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.jamo(F.concat(F.lit("가나x"), F.col("doc_id").cast("string"), F.lit("닭"))).alias("jamo"))


@query("text_decorated_alias", r"SELECT doc_id AS id, split_part(text, ' ', 1) || ' x' AS found FROM documents WHERE NOT regexp_matches(split_part(text, ' ', 1), '[\"''()\[\]《》〈〉「」『』]')")
def text_decorated_alias(spark, sf_dir):
    word = F.split_part("text", F.lit(" "), F.lit(1))
    title = F.concat(F.lit('About "'), word, F.lit(' x" today'))
    return table(spark, sf_dir, "documents").where(~word.rlike("[\"'()\\[\\]《》〈〉「」『』]")).select(F.col("doc_id").alias("id"), F.array_join(T.decorated_aliases(title), "|").alias("found"))


@query("text_split_alias", "SELECT doc_id AS id, array_to_string(list_filter([trim(x) FOR x IN string_split(split_part(text, ' ', 1) || ' / ' || lang || ' / z', '/')], lambda x: x <> ''), '|') AS parts FROM documents WHERE NOT contains(split_part(text, ' ', 1), '/') AND split_part(text, ' ', 1) NOT IN (lang, 'z') AND NOT regexp_matches(split_part(text, ' ', 1), '\\s')")
def text_split_alias(spark, sf_dir):
    word = F.split_part("text", F.lit(" "), F.lit(1))
    kept = table(spark, sf_dir, "documents").where(~word.contains("/") & (word != F.col("lang")) & (word != "z") & ~word.rlike("\\s"))
    return kept.select(F.col("doc_id").alias("id"), F.array_join(T.split_aliases(F.concat(word, F.lit(" / "), F.col("lang"), F.lit("/z"))), "|").alias("parts"))


@query("text_dateline_strip", f"WITH {DOCS} SELECT id, trim(regexp_replace(title, '[ \\t\\n\\r\\f\\x{{000B}}\\x{{00A0}}]+', ' ', 'g')) || ' tail' AS plain FROM docs WHERE trim(regexp_replace(title, '[ \\t\\n\\r\\f]+', ' ', 'g')) <> ''")
def text_dateline_strip(spark, sf_dir):
    kept = docs(spark, sf_dir).where(T.squeezed(F.col("title")) != "")
    return kept.select("id", T.without_dateline(F.concat(F.col("title"), F.lit(" (Geneva January 5 Wire) tail"))).alias("plain"))


@query("text_markdown_clean", "SELECT doc_id AS id, 'Head ' || lang || ' text bold' AS plain FROM documents")
def text_markdown_clean(spark, sf_dir):
    md = F.concat(F.lit("# Head\n![i](x.png) ["), F.col("lang"), F.lit("](http://a.b/c)\n- text **bold**"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.markdown_plain(md).alias("plain"))


@query("text_html_escape", """SELECT doc_id AS id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents""")
def text_html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.html_escape(F.col("text")).alias("html"))


@query("text_paragraphs", "SELECT doc_id AS id, CAST(len(list_filter(string_split_regex(text, '\\n+'), lambda x: trim(x) <> '')) AS INTEGER) AS n FROM documents")
def text_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(T.paragraphs(F.col("text"))).alias("n"))


@query("text_longest_choice", "SELECT doc_id AS id, CASE WHEN length(split_part(text, '.', 2)) >= length(split_part(text, '.', 1)) THEN split_part(text, '.', 2) ELSE split_part(text, '.', 1) END AS longest FROM documents")
def text_longest_choice(spark, sf_dir):
    part = lambda k: F.split_part("text", F.lit("."), F.lit(k))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.longest(part(1), part(2)).alias("longest"))


@query("text_repeated", f"WITH {DOCS} SELECT id, least(length({_simple('title')}), length({_simple('snippet')})) >= 20 AND (starts_with({_simple('title')}, {_simple('snippet')}) OR starts_with({_simple('snippet')}, {_simple('title')})) AS repeated FROM docs")
def text_repeated(spark, sf_dir):
    return docs(spark, sf_dir).select("id", T.repeated(F.col("title"), F.col("snippet")).alias("repeated"))


@query("line_dedupe", """WITH l AS (SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))
SELECT doc_id AS id, string_agg(line, chr(10) ORDER BY k) FILTER (n = 1 OR length(line) < 8) AS text, CAST(count(*) FILTER (n > 1 AND length(line) >= 8) AS INTEGER) AS dropped FROM l GROUP BY 1""")
def line_dedupe(spark, sf_dir):
    return W.without_repeated_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text")


@query("lang_infer", "SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+/(ko|en|ja|zh|ru|es|fr|de|ar)([/?#]|$)', 1) <> '' THEN regexp_extract(url, '^[a-z]+://[^/]+/(ko|en|ja|zh|ru|es|fr|de|ar)([/?#]|$)', 1) WHEN regexp_matches(html, '[A-Za-z]{3}') THEN 'en' ELSE 'ko' END AS language FROM pages")
def lang_infer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.language(F.col("url"), F.col("html")).alias("language"))


@query("media_infer", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'image' WHEN page_id % 4 = 2 THEN 'video' ELSE 'article' END AS media FROM pages")
def media_infer(spark, sf_dir):
    tail = F.get(F.array(F.lit("x.pdf?a=1"), F.lit("y.JPG"), F.lit("video/1"), F.lit("page")), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.media_type(F.concat(F.lit("https://a.example.org/"), tail)).alias("media"))


@query("url_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("url_canonical", r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)), '://www\.', '://') || regexp_extract(u, '^[A-Za-z]+://[^/?]*(.*)$', 1), '[?&/]+$', '') AS url
FROM (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '?&', '?') AS u FROM pages)""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query("url_date", "SELECT doc_id AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) AS date FROM documents")
def url_date(spark, sf_dir):
    d = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    form = F.when(F.col("doc_id") % 2 == 0, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyyMMdd"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), dates.from_url(F.concat(F.lit("https://a.example.org/n/"), form, F.lit("/story-7.html"))).cast("string").alias("date"))


@query("url_video_id", "SELECT doc_id AS id, CASE WHEN doc_id % 3 < 2 THEN lpad(CAST(doc_id AS VARCHAR), 11, 'a') ELSE '' END AS video FROM documents")
def url_video_id(spark, sf_dir):
    v = F.lpad(F.col("doc_id").cast("string"), 11, "a")
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.example.tube/watch?v="), v)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=1"))).otherwise(F.lit("https://a.example.org/"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), urls.video_id(url).alias("video"))


@query("fnv_shard")
def fnv_shard(spark, sf_dir):
    """FNV-1a is a fold that DuckDB's reduce can't do without overflow checks; tests compare it with plain Python."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), urls.fnv1a(F.col("doc_id").cast("string")).alias("hash"), urls.shard(F.col("doc_id").cast("string")).alias("shard"))


@query("sha_ids", "SELECT doc_id AS id, left(sha1(url), 16) AS crawl, left(sha256(url), 24) AS news, sha256(url || chr(10) || lang) AS pair FROM (SELECT doc_id, 'https://a.example.org/' || CAST(doc_id AS VARCHAR) AS url, lang FROM documents)")
def sha_ids(spark, sf_dir):
    u = F.concat(F.lit("https://a.example.org/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), urls.crawl_id(u).alias("crawl"), urls.news_id(u).alias("news"), urls.pair_hash(u, F.col("lang")).alias("pair"))


@query("base64_token", "SELECT doc_id AS id, regexp_replace(translate(to_base64(encode(text)), '+/', '-_'), '=+$', '') AS token FROM documents")
def base64_token(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), urls.base64url(F.col("text")).alias("token"))


@query("hmac_ids")
def hmac_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), urls.hmac_sha256(b"key", F.col("doc_id").cast("string")).alias("mac"))


_DAY = "DATE '2024-01-01' + CAST(event_id % 366 AS INTEGER)"


@query("date_parse_multi", f"SELECT event_id, CAST(CASE WHEN event_id % 6 = 5 THEN DATE '2024-07-01' ELSE {_DAY} END AS VARCHAR) AS day FROM events")
def date_parse_multi(spark, sf_dir):
    d = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 366).cast("int"))
    forms = ["yyyy-MM-dd", "yyyy'년' M'월' d'일'", "MMMM d, yyyy", "M.d.yyyy", "d/M/yyyy"]
    text = F.lit("no day here")
    for k, f in enumerate(forms):
        text = F.when(F.col("event_id") % 6 == k, F.concat(F.lit("on "), F.date_format(d, f), F.lit(" there"))).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", dates.parse(text, F.lit("2024-07-01").cast("date")).cast("string").alias("day"))


@query("date_validate", "SELECT doc_id AS id, TRY_CAST(s AS DATE) IS NOT NULL AS ok FROM (SELECT doc_id, '2023-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS s FROM documents)")
def date_validate(spark, sf_dir):
    two = lambda m: F.lpad((F.col("doc_id") % m).cast("string"), 2, "0")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), dates.calendar(F.concat(F.lit("2023-"), two(14), F.lit("-"), two(33))).isNotNull().alias("ok"))


@query("date_literal_bounds", "SELECT CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS literal, CAST(make_date(y, m, 1) AS VARCHAR) AS first, CAST(last_day(make_date(y, m, 1)) AS VARCHAR) AS last FROM (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)")
def date_literal_bounds(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    return months.select(F.date_format("d", "yyyy-MM").alias("literal"), F.col("d").cast("string").alias("first"), F.last_day("d").cast("string").alias("last"))


@query("date_dateline_year", "SELECT doc_id AS id, CASE WHEN doc_id % 12 + 1 <= 6 THEN '2024-' ELSE '2023-' END || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS day FROM documents")
def date_dateline_year(spark, sf_dir):
    text = F.concat(F.lit("(서울 "), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("월 5일발)"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), dates.dateline_day(text, F.lit("2024-06-15").cast("date")).cast("string").alias("day"))


@query("date_clamp_recent", "SELECT event_id, CAST(least(CAST(ts AS DATE), DATE '2024-01-15') AS VARCHAR) AS day, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 7 AS recent, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def date_clamp_recent(spark, sf_dir):
    d = F.to_date("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.clamped(d, F.lit("2024-01-15").cast("date")).cast("string").alias("day"), (F.datediff(F.lit("2024-01-30").cast("date"), d) <= 7).alias("recent"), dates.iso_millis(F.col("ts")).alias("iso"))


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).cast("long").alias("k"))


@query("document_normalize", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, 'archive' AS sourceType, 'article' AS mediaType, coalesce(lang, 'ko') AS language, source AS displaySourceId, '' AS url FROM documents")
def document_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("language"), F.col("source").alias("sourceId"))
    return schema.normalized(rows).select("id", "title", "sourceType", "mediaType", "language", "displaySourceId", "url")
