"""Helpers shared by the operators: shared folders, global ranks, small literal tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.common import ship

WORD = r"[^\x20\x09-\x0D]+"
_ROW_MASK = (1 << 33) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where it is unset and all runs in one process."""
    ship(spark)
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        at = at and at.rsplit("/", 1)[0]
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quarry/{what}-{uuid.uuid4().hex}"


#: Tables that `kept` wrote and nobody has dropped, in order.
_MADE: list[str] = []


def drop_made(spark: SparkSession, since: int) -> None:
    """Drops what `kept` wrote after the first `since` tables, but for the last one. Their DataFrames end with them."""
    for path in _MADE[since:-1]:
        drop_path(spark, path)
    _MADE[since:-1] = []


def made() -> int:
    return len(_MADE)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of planning metadata, made by the JVM from one JSON literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def global_index(df: DataFrame, keys: list[Column], name: str = "idx") -> DataFrame:
    """Adds the 0-based place of each row in the order of keys.

    Rows are dealt by range and sorted where they are; the sorted partitions are checkpointed,
    so their counts and the numbers made from them cannot disagree after a lost executor. Only one
    count for each partition reaches the driver. The row's input place is the last key, so rows that
    tie in every key (repeated rows, null keys) are still dealt over many partitions.
    """
    shared_dir(df.sparkSession)
    dealt = df.withColumn("_at", F.monotonically_increasing_id())
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    dealt = dealt.select("*", *named)
    order = [F.col(f"_k{i}") for i in range(len(keys))] + [F.col("_at")]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop(*[f"_k{i}" for i in range(len(keys))], "_at")
    dealt = dealt.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)).alias("_i"))
    dealt = dealt.checkpoint()
    counts = dict(dealt.groupBy("_p").count().collect())
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(str(total))
        total += counts.get(p, 0)
    start = F.element_at(F.split(F.lit(",".join(starts)), ","), F.col("_p") + 1).cast("long")
    return dealt.withColumn(name, start + F.col("_i")).drop("_p", "_i")
