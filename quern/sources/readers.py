"""Scans of JSON Lines, JSON, XML feeds, sitemaps, Markdown tables, delimited lists and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quern.functions import dates, schema, text as T


def json_lines(spark: SparkSession, paths: str | list[str], kind: StructType = schema.DOCUMENT, strict: bool = True) -> DataFrame:
    """One object a line; several paths are one relation.  Strict: a broken line fails the scan."""
    return spark.read.schema(kind).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def _listed(raw: Column) -> Column:
    """Whether JSON text is an array: from_json would read an object as an array of one."""
    return F.ltrim(raw).startswith("[")


def json_documents(spark: SparkSession, path: str, kind: StructType = schema.DOCUMENT, wrapper: str = "documents") -> DataFrame:
    """A JSON array, or an object that holds one under `wrapper`."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.when(_listed(F.col("value")), F.from_json("value", f"array<{kind.simpleString()}>")).otherwise(F.from_json("value", f"struct<{wrapper}:array<{kind.simpleString()}>>")[wrapper])
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths of either kind, in order, as one relation; none give an empty one."""
    out = spark.createDataFrame([], schema.DOCUMENT)
    for p in (q.strip() for x in paths for q in x.split(",")):
        out = out.unionByName(json_lines(spark, p) if p.endswith(".jsonl") else json_documents(spark, p))
    return out


def strict_news(lines: DataFrame) -> DataFrame:
    """News rows of text lines, with their unknown keys: a row with any is to be rejected."""
    from quern.operators.quality import unknown_keys

    return lines.where(F.trim("value") != "").select(F.from_json("value", schema.NEWS).alias("row"), unknown_keys(F.col("value"), tuple(schema.NEWS.fieldNames())).alias("unknown"))


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS items or Atom entries by Spark's own XML reader."""
    link = "link string" if tag == "item" else "link struct<_href:string>"
    kind = f"title string, {link}, guid string, id string, pubDate string, published string, updated string, description string, summary string"
    raw = spark.read.format("xml").option("rowTag", tag).schema(kind).load(path)
    url = F.col("link") if tag == "item" else F.col("link._href")
    return raw.select(T.squeezed(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce(url, "guid", "id")).alias("url"), F.coalesce("pubDate", "published", "updated").alias("published"), F.coalesce("description", "summary", F.lit("")).alias("summary"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a sitemap, with dates and images."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, `image:image` array<struct<`image:loc`:string>>").load(path).select(F.trim("loc").alias("url"), "lastmod", F.transform("image:image", lambda i: i["image:loc"]).alias("images"))


def markdown_table(lines: DataFrame, cells: int) -> DataFrame:
    """Rows of pipe tables with exactly `cells` cells; escaped pipes are part of a cell."""
    body = F.regexp_replace(F.regexp_replace(F.trim("value"), "^\\||\\|$", ""), "\\\\\\|", "￾")
    parts = F.transform(F.split(body, "\\|"), lambda c: F.trim(F.regexp_replace(c, "￾", "|")))
    rule = F.col("value").rlike("^\\s*\\|?[\\s:|-]+\\|?\\s*$")
    return lines.where(F.trim("value").startswith("|") & ~rule).select(*[c for c in lines.columns if c != "value"], parts.alias("cells")).where(F.size("cells") == cells)


def headed_table(lines: DataFrame, at: str, cells: int) -> DataFrame:
    """The same, with the last second- or third-level heading above each row; `at` orders the lines."""
    from pyspark.sql import Window

    head = F.regexp_extract("value", "^#{2,3}\\s+(.*)$", 1)
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return markdown_table(lines.withColumn("series", F.last(F.when(head != "", head), ignorenulls=True).over(w)), cells)


def delimited(lines: DataFrame, at: str, mark: str = "@") -> DataFrame:
    """title@artist@album lines, comments skipped; numbers count all other lines."""
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(at, F.transform(F.split("value", mark), F.trim).alias("fields"))


def playlists(raw: Column) -> Column:
    """An array, or an object with playlists or items; else lines of title@cover@id,id; HTML gives none."""
    kind = "array<struct<title:string,cover:string,ids:array<string>>>"
    parsed = F.coalesce(F.when(_listed(raw), F.from_json(raw, kind)), F.from_json(raw, f"struct<playlists:{kind}>")["playlists"], F.from_json(raw, f"struct<items:{kind}>")["items"])
    lines = F.transform(F.filter(F.split(raw, "\n"), lambda x: x.contains("@")), lambda x: F.struct(F.get(F.split(x, "@"), F.lit(0)).alias("title"), F.get(F.split(x, "@"), F.lit(1)).alias("cover"), F.split(F.coalesce(F.get(F.split(x, "@"), F.lit(2)), F.lit("")), ",").alias("ids")))
    return F.when(F.ltrim(raw).startswith("<"), F.array().cast(kind)).otherwise(F.coalesce(parsed, lines))


def markdown_links(lines: DataFrame, doc: str, at: str) -> DataFrame:
    """Links of Markdown lines with a day from the rest of the line, else from the lines around: up to three before, two after."""
    from pyspark.sql import Window

    day = "(\\d{4}[-./]\\d{1,2}[-./]\\d{1,2})"
    w = Window.partitionBy(doc).orderBy(at)
    near = F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(f("value", k).over(w), F.lit("")), day, 1), F.lit("")) for f, k in ((F.lag, 1), (F.lag, 2), (F.lag, 3), (F.lead, 1), (F.lead, 2))))
    out = lines.withColumn("date", F.coalesce(F.nullif(F.regexp_extract("value", day, 1), F.lit("")), near))
    link = F.explode(F.regexp_extract_all("value", F.lit("(?<!!)\\[[^\\]]*\\]\\([^)\\s]+\\)"), F.lit(0)))
    return out.withColumn("_l", link).select(doc, at, F.regexp_extract("_l", "\\[([^\\]]*)\\]", 1).alias("label"), F.regexp_extract("_l", "\\(([^)]*)\\)", 1).alias("url"), "date")


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links of pages in order, with their text: built-in functions only."""
    tag = "<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit("(?is)" + tag), F.lit(0))).alias("place", "_a"))
    plain = T.squeezed(F.regexp_replace("_a", "<[^>]*>", ""))
    return found.select(key, "place", F.regexp_extract("_a", "(?i)href=\"([^\"]*)\"", 1).alias("href"), plain.alias("label"))


def page_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title cascade and language of pages: heading, title element; body length."""
    heading, title = F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    strip = lambda c: T.squeezed(F.regexp_replace(c, "<[^>]*>", ""))
    return pages.select(key, T.first_filled(strip(heading), strip(title)).alias("title"), F.regexp_extract(html, "(?i)<html[^>]*\\slang=\"([a-z-]+)\"", 1).alias("language"), F.size(F.regexp_extract_all(html, F.lit("(?i)<p[\\s>]"), F.lit(0))).alias("paragraphs"))


def robots_rules(lines: DataFrame, host: str, at: str) -> DataFrame:
    """Rules for all agents of robots.txt lines: a group begins at an agent line that follows a rule."""
    from pyspark.sql import Window

    name, value = F.lower(F.trim(F.regexp_extract("value", "^([^:#]+):", 1))), F.trim(F.regexp_extract("value", "^[^:]+:([^#]*)", 1))
    w = Window.partitionBy(host).orderBy(at)
    rows = lines.select(host, at, name.alias("name"), value.alias("rule"))
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("_b", begins.cast("int")).withColumn("group", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = rows.where("name = 'user-agent' AND rule = '*'").select(host, "group").distinct()
    return rows.where("name IN ('allow', 'disallow') AND rule <> ''").join(mine, [host, "group"]).select(host, "rule", (F.col("name") == "allow").alias("allow"))


def decoded(files: DataFrame) -> DataFrame:
    """Text of binary files: byte-order marks, UTF-16 by its zero bytes, a declared charset, else UTF-8."""
    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        import re

        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            if raw[:3] == b"\xef\xbb\xbf":
                return raw[3:].decode("utf-8", "replace")
            if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
                return raw.decode("utf-16", "replace")
            if raw and raw[:200].count(0) > len(raw[:200]) * 0.2:
                return raw.decode("utf-16-le" if raw[1:2] == b"\0" else "utf-16-be", "replace")
            m = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", raw[:2048])
            try:
                return raw.decode(m[1].decode() if m else "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")

        return data.map(one)

    return files.withColumn("text", decode("content"))


def archive_members(files: DataFrame, suffixes: tuple[str, ...] = (".ttf", ".otf")) -> DataFrame:
    """Names and sizes of members of ZIP files."""

    def run(batches):
        import io
        import zipfile

        for b in batches:
            rows = [(p, i.filename, i.file_size) for p, c in zip(b["path"], b["content"], strict=True) for i in zipfile.ZipFile(io.BytesIO(c)).infolist() if i.filename.lower().endswith(suffixes)]
            yield pd.DataFrame(rows, columns=["path", "member", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long")


def timetable(raw: Column) -> Column:
    """Programmes of several nestings: a list, {programs}, {schedule}, {data: {list}}; a single one as a list."""
    kind = "array<struct<time:string,title:string>>"
    shapes = [F.when(_listed(raw), F.from_json(raw, kind))] + [F.from_json(raw, f"struct<{k}:{kind}>")[k] for k in ("programs", "schedule")] + [F.from_json(raw, f"struct<data:struct<list:{kind}>>")["data"]["list"]]
    single = F.from_json(raw, "struct<time:string,title:string>")
    return F.coalesce(*shapes, F.when(single["time"].isNotNull(), F.array(single)), F.array().cast(kind))


def first_success(readers: list) -> DataFrame:
    """The first reader that doesn't raise; the last error if all do."""
    error: Exception | None = None
    for r in readers:
        try:
            return r()
        except Exception as e:  # noqa: BLE001
            error = e
    raise error or ValueError("no reader")


def cursor(fetch, start: str, limit: int) -> list[dict]:
    """Rows of a paginated source that names its next page, until `limit`; the fetcher is injected."""
    rows, at = [], start
    while at and len(rows) < limit:
        page = fetch(at)
        rows += page["items"]
        at = page.get("next")
    return rows[:limit]


def frontier(links: DataFrame, start: list[str], rounds: int) -> DataFrame:
    """Breadth-first reach over (url, target) links with a visited set; every round is one anti-join, cut from the one before by checkpoint()."""
    spark = links.sparkSession
    seen = spark.createDataFrame([(u, 0) for u in start], "url string, depth int")
    last = seen
    for k in range(1, rounds + 1):
        new = last.join(links, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(k))
        last = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new
        seen = seen.unionByName(last)
    return seen


def wordpress(raw: Column) -> Column:
    """Posts of a REST answer, also inside noise: from the first bracket to the last."""
    kind = "array<struct<id:bigint,date:string,link:string,title:struct<rendered:string>,content:struct<rendered:string>>>"
    return F.from_json(F.regexp_extract(raw, "(?s)(\\[.*\\])", 1), kind)


def parsed_day(c: Column, as_of: str) -> Column:
    return dates.parse(c, F.lit(as_of).cast("date"))
