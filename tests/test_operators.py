"""Operators beyond SQL, and edge cases, against plain Python."""

import hashlib
import hmac
import unicodedata

from pyspark.sql import functions as F

from quern.catalog import QUERIES
from quern.functions import schema, text as T, urls
from quern.operators import dedupe as D, joins as J, search as S, windows as W
from quern.plans.language import prepare
from quern.sources import readers as R, writers as K
from quern.streaming.limits import decide


def test_hashes(spark, data):
    for r in QUERIES["fnv_shard"](spark, data).collect():
        h = 2166136261
        for b in str(r.id).encode():
            h = (h ^ b) * 16777619 % 2**32
        assert r.hash == h and r.shard == f"{h & 255:02x}"
    for r in QUERIES["hmac_ids"](spark, data).limit(20).collect():
        assert r.mac == hmac.new(b"key", str(r.id).encode(), hashlib.sha256).hexdigest()


def test_shards_are_complete(spark, data):
    rows = QUERIES["shard_index"](spark, data).collect()
    assert len(rows) == 256 and sum(r.n for r in rows) == 200


def test_rate_limit_equals_plain_fold_and_stream(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts as timestamp)) as ms").collect()
    want, state = {}, {}
    for e in sorted(events, key=lambda e: (e.ms, e.event_id)):
        kept = state.setdefault(e.user_id, [])
        ok, wait = decide(kept, e.ms)
        if ok:
            kept.append(e.ms)
        want[e.event_id] = (ok, wait)
    assert {r.event_id: (r.accepted, r.retry_after) for r in QUERIES["rate_limit_exact"](spark, data).collect()} == want
    assert {r.event_id: (r.accepted, r.retry_after) for r in QUERIES["stream_rate_limit"](spark, data).collect()} == want


def test_streamed_rows_stay_in_files(spark, data, tmp_path):
    """The stream's rows are as many as its input's: they lie in files, not in a table on the driver; no events give no rows."""
    assert QUERIES["stream_rate_limit"](spark, data).inputFiles()
    spark.read.parquet(f"{data}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    none = QUERIES["stream_rate_limit"](spark, str(tmp_path))
    assert none.columns == ["user_id", "event_id", "accepted", "retry_after"] and none.count() == 0


def test_limits():
    assert decide([], 0) == (True, 0) and decide([0], 14_000) == (False, 1) and decide([0], 15_000) == (True, 0)
    assert not decide([0, 20_000, 40_000, 60_000, 80_000], 100_000)[0]


def test_nfkc_and_jamo(spark):
    df = spark.createDataFrame([("ｱＢ①",), (None,), ("",), ("각x",)], "t string")
    rows = df.select(T.nfkc("t").alias("n"), T.jamo(F.col("t")).alias("j")).collect()
    assert [r.n for r in rows] == [unicodedata.normalize("NFKC", "ｱＢ①"), None, "", "각x"] and rows[3].j == "ㄱㅏㄱx"


def test_ngrams_of_long_texts(spark):
    """The text's form is computed once, not for each n-gram; the first 240 are those of the whole text."""
    texts = ["A b-c " * 5_000, "가나 " * 121, "ab", "x", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").select("id", T.ngrams(T.token(F.col("t"))["lower"]).alias("grams"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    for r in df.collect():
        s = (texts[r.id] or "").replace(" ", "").replace("-", "").lower()
        assert r.grams == [s[k : k + n] for n in (2, 3, 4) for k in range(len(s) - n + 1)][:240]


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "id long, title string, snippet string, body string, date string, language string, sourceId string, sourceName string, sourceType string, displaySourceId string, mediaType string, url string, displayOrder int")
    assert S.search(docs, prepare("foo bar")).count() == 0


def test_nulls_in_search(spark):
    docs = spark.createDataFrame([(1, None, "foo bar", None, None, None, "s", None, None, None, "article", None, 1), (2, "foo", None, "bar", "2024-01-01", "en", "s", "S", "x", "", "pdf", "u", 1)], "id long, title string, snippet string, body string, date string, language string, sourceId string, sourceName string, sourceType string, displaySourceId string, mediaType string, url string, displayOrder int")
    assert {r.id for r in S.search(docs, prepare("foo bar")).collect()} == {1, 2}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "x", "aliases": ["y"]}\n{"id": "2"}\n')
    (tmp_path / "b.json").write_text('{"documents": [{"id": "3"}]}')
    (tmp_path / "c.json").write_text('[{"id": "4"}]')
    rows = R.documents(spark, [f"{tmp_path}/a.jsonl,{tmp_path}/b.json", f"{tmp_path}/c.json"]).collect()
    assert sorted(r.id for r in rows) == ["1", "2", "3", "4"]
    out = schema.normalized(R.documents(spark, [f"{tmp_path}/a.jsonl"])).collect()
    assert out[0].language == "ko" and out[1].title == "" and out[1].aliases == []


def test_feed_and_sitemap(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A  b</title><link> http://x/1 </link><pubDate>d</pubDate></item><item><guid>g</guid></item></channel></rss>")
    rows = R.feed(spark, f"{tmp_path}/f.xml").collect()
    assert [(r.title, r.url) for r in rows] == [("A b", "http://x/1"), ("", "g")]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://x/2</loc><lastmod>2024-01-01</lastmod></url></urlset>")
    assert [r.url for r in R.sitemap(spark, f"{tmp_path}/s.xml").collect()] == ["http://x/2"]


def test_strict_news_rows(spark):
    lines = spark.createDataFrame([('{"id": "a", "bad": 1}',), ("",), ('{"id": "b"}',)], "value string")
    assert sorted((r.row.id, list(r.unknown)) for r in R.strict_news(lines).collect()) == [("a", ["bad"]), ("b", [])]


def test_timetable_shapes(spark):
    raw = ['[{"time":"09:00","title":"a"}]', '{"programs":[{"time":"09:00","title":"a"}]}', '{"data":{"list":[{"time":"09:00","title":"a"}]}}', '{"time":"09:00","title":"a"}', "nothing"]
    rows = spark.createDataFrame([(x,) for x in raw], "r string").select(R.timetable(F.col("r")).alias("t")).collect()
    assert [len(r.t) for r in rows] == [1, 1, 1, 1, 0]


def test_decoding_and_archives(spark, tmp_path):
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.ttf", "x")
        f.writestr("b.txt", "y")
    files = spark.createDataFrame([("a", bytearray("가".encode("utf-16"))), ("b", bytearray("<meta charset=euc-kr>가".encode("euc-kr"))), ("c", None)], "path string, content binary")
    assert [r.text for r in R.decoded(files).orderBy("path").collect()] == ["가", "<meta charset=euc-kr>가", None]
    assert [r.member for r in R.archive_members(spark.createDataFrame([("z", bytearray(z.getvalue()))], "path string, content binary")).collect()] == ["a.ttf"]


def test_publish_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    K.publish(df, str(tmp_path / "t"), "1")
    K.publish(df.where("v = 1"), str(tmp_path / "t"), "2")
    assert K.published(spark, str(tmp_path / "t")).count() == 1
    K.sharded(df, "id", str(tmp_path / "s"))
    assert [r.v for r in K.lookup(spark, str(tmp_path / "s"), "id", "b").collect()] == [2]
    assert not K.stale(df, df) and K.stale(df, df.where("v = 1"))


def test_asset_names(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xd8\xff1234567890"),), (bytearray(b"\xff\xd8\xff1234567890"),), (bytearray(b"nope"),)], "content binary")
    assert [r.asset.rsplit(".")[-1] for r in K.asset_names(df).collect()] == ["jpg"]


def test_overlay_and_ties(spark):
    live = spark.createDataFrame([("u1", None, "2024-01-02")], "url string, title string, date string")
    old = spark.createDataFrame([("u1", "t", "2024-01-01"), ("u2", "s", "2024-01-01")], "url string, title string, date string")
    assert sorted((r.url, r.title, r.origin) for r in J.overlay(live, old, "url").collect()) == [("u1", "t", "live"), ("u2", "s", "published")]
    same = spark.createDataFrame([(1, "a"), (1, "a")], "id long, v string")
    assert D.best_of(same, ["id"], F.col("v")).count() == 1


def test_page_window():
    assert W.page_window(1, 10) == [1, 2, 3, 4, 5] and W.page_window(10, 10) == [6, 7, 8, 9, 10] and W.page_window(1, 2) == [1, 2]


def test_urls(spark):
    row = spark.range(1).select(urls.host(F.lit("HTTPS://www.A.example.org:80/x")).alias("h"), urls.host(F.lit("no url")).alias("n"), urls.safe_asset(F.lit("a/../b")).alias("s")).first()
    assert (row.h, row.n, row.s) == ("a.example.org", "", False)


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
