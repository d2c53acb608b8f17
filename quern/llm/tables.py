"""Tables in the shared folder, to cut lineage where a result is used more than once; joins that deal hot keys out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one key that one task joins, and the most keys that may have more: it bounds what is broadcast.
HOT_ROWS, HOT_KEYS = 256, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Without the setting a temporary one serves a local master, as in tests;
    a cluster's machines share none, so there it's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quern_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = spark._quern_dir = tempfile.mkdtemp(prefix="quern-")
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, with the same columns.  Any lost executor's part can be read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark frees shuffle files and broadcasts of plans that the driver has collected as garbage: what this table needed goes now.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many joined with one, of one row a key, on keys.  sizes (keys, n) tells how many rows of `many` a key has: a key of
    over HOT_ROWS (and over the HOT_KEYS-th part of all) is dealt over several tasks by the hash of column `by`, its row of
    `one` copied to each.  Hot keys are at most HOT_KEYS, so their list is broadcast."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")
