"""Sinks: canonical JSON Lines, hash shards, category pages, versioned publication, asset stores, staleness checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions import urls
from quern.operators.dedupe import differences
from quern.operators.windows import pages


def json_lines(df: DataFrame, path: str, ordering: list[Column] | None = None) -> None:
    """One object a line; with an order, in files that follow it (a range sort, not one task)."""
    (df.orderBy(*ordering) if ordering else df).write.mode("overwrite").json(path)


def sharded(df: DataFrame, key: str, path: str) -> None:
    """Detail rows under 256 shards by hash of key; one partition each."""
    df.withColumn("shard", urls.shard(F.col(key))).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_index(df: DataFrame, key: str) -> DataFrame:
    """Rows of each of the 256 shards, empty ones included."""
    counts = df.groupBy(urls.shard(F.col(key)).alias("shard")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("shard"))
    return every.join(counts, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))


def lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A point lookup that reads one shard."""
    h = 2166136261
    for ch in value:
        h = (h ^ ord(ch)) * 16777619 % (1 << 32)
    return spark.read.parquet(path).where((F.col("shard") == f"{h & 255:02x}") & (F.col(key) == value))


def category_pages(df: DataFrame, sections: DataFrame, keys: list[str], ordering: list[Column], item: str, size: int = 5) -> DataFrame:
    """A row for each page of each section, its items in the page's order; one empty page where a section has no rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)).alias("_place")
    paged = pages(df, keys, ordering, size).select("*", place).groupBy(*keys, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col(item).cast("string").alias("_item")))), lambda x: x["_item"]), ",").alias("items"), F.count("*").alias("n"))
    return sections.join(paged, keys, "left").select(*keys, F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n", F.lit(0)).alias("n"))


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a version beside the others and names it current last, in a file of its own that appears by one rename:
    readers see one whole version or the one before, and never none."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    names, system = _pointers(spark, root)
    number = max(names, default=0) + 1
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = f"{root.rstrip('/')}/current"
    system.mkdirs(kind(folder))
    out = system.create(kind(f"{folder}/.{number}-{uuid.uuid4().hex}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    written = next(f.getPath() for f in system.listStatus(kind(folder)) if f.getPath().getName().startswith(f".{number}-"))
    if not system.rename(written, kind(f"{folder}/{number:012d}")):
        raise RuntimeError("another publication got this number")
    return path


def _pointers(spark: SparkSession, root: str):
    """Numbers of the publications under a root, and its file system."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = kind(f"{root.rstrip('/')}/current")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return [int(n) for n in names if n.isdigit()], system


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the latest publication names."""
    last = max(_pointers(spark, root)[0])
    current = spark.read.text(f"{root.rstrip('/')}/current/{last:012d}", wholetext=True).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/version={current}")


def stale(df: DataFrame, existing: DataFrame) -> bool:
    """Whether a recomputed table differs from the published one."""
    return not differences(df, existing).isEmpty()


def asset_names(files: DataFrame) -> DataFrame:
    """Content-addressed names of image files: equal bytes get one name; other formats none."""
    kind = urls.image_format(F.col("content"))
    return files.where(kind.isNotNull()).select(F.concat_ws(".", F.sha2("content", 256), kind).alias("asset"), "content").dropDuplicates(["asset"])


def unreferenced(assets: DataFrame, references: DataFrame) -> DataFrame:
    return assets.join(references, "asset", "left_anti")


def work_list(wanted: DataFrame, manifest: DataFrame, stamps: list[str]) -> DataFrame:
    """Rows whose stamps are not in the manifest: what an incremental build has to do."""
    return wanted.join(manifest.select("key", *stamps), ["key", *stamps], "left_anti")


def seed(docs: DataFrame) -> DataFrame:
    """One payload row of each document for a search index."""
    return docs.select("id", F.to_json(F.struct(*sorted(docs.columns))).alias("payload"))


def synonyms(entries: DataFrame) -> DataFrame:
    """canonical -> labels as one map column of a small table of entities."""
    return entries.groupBy("canonical").agg(F.array_sort(F.collect_set("label")).alias("labels"))
