"""What the mining strategies share."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # not within a zip that was sent already
        at = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(at))
    _SHIPPED.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the cluster's shared folder; a local one is set only where none is named and all is one process."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='quarry-')}")
    return df.checkpoint()


def kth(found: DataFrame, k: int, theta: int) -> int:
    """The k-th utility of (…, utility), if there are k; k numbers reach the driver."""
    top = found.select("utility").filter(F.col("utility") >= theta).orderBy(F.col("utility").desc()).limit(k).collect()
    return max(theta, top[-1]["utility"]) if len(top) == k else theta


def raised(best: list[int], level: DataFrame, column: str, k: int, theta: int) -> tuple[list[int], int]:
    """The k largest values so far with those of a new level, and theta, raised to the k-th if there are k."""
    new = [r[0] for r in level.select(column).orderBy(F.col(column).desc()).limit(k).collect()]
    best = sorted([*best, *new], reverse=True)[:k]
    return best, max(theta, best[-1]) if len(best) == k else theta


def top(found: DataFrame, k: int, ties: str) -> DataFrame:
    """The k rows of largest utility, smaller itemsets first among equals, or with all that tie with the k-th.

    exact is an ordered limit, of which each task keeps k rows. For ties the k-th utility is found the same way
    first, and only rows that reach it are ranked.
    """
    found = found.filter("utility > 0")
    if ties == "exact":
        return found.orderBy(F.col("utility").desc(), "itemset").limit(k)
    if ties != "all":
        raise ValueError(f"ties {ties!r}")
    found = found.filter(F.col("utility") >= kth(found, k, 1))
    rank = F.rank().over(W.orderBy(F.col("utility").desc()))
    return found.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """Itemsets of ranks as sorted itemsets of items; one row for each rank and result meets the names (item, rank)."""
    out = found.select("ranks", "utility", "support", F.explode("ranks").alias("rank")).join(names, "rank")
    return out.groupBy("ranks", "utility", "support").agg(F.array_sort(F.collect_list("item")).alias("itemset")).select("itemset", "utility", "support")
