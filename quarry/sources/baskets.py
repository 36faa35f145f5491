"""Utility lines (tid, item, util) from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.itemsets import cents


def baskets(df: DataFrame, tid: Column, item: Column, measure: Column | None = None, scale: int = 100, util: Column | None = None) -> DataFrame:
    """One line for each transaction and item; repeated lines are summed.

    Give either a decimal measure, counted in 1/scale, or util in whole units. Rows without a transaction, item or
    utility are left out. A negative sum raises when the lines are read.
    """
    value = cents(measure, scale) if util is None else util.cast("long")
    rows = df.select(tid.alias("tid"), item.alias("item"), value.alias("util")).dropna()
    return checked(rows.groupBy("tid", "item").agg(F.sum("util").alias("util")))


def checked(lines: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("negative utility of item "), F.col("item").cast("string")))
    return lines.withColumn("util", F.when(F.col("util") >= 0, F.col("util")).otherwise(bad.cast("long")))


def transactions(lines: DataFrame) -> DataFrame:
    """(tid, tu, n): transaction utility and length."""
    return lines.groupBy("tid").agg(F.sum("util").alias("tu"), F.count("*").alias("n"))
