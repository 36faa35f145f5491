"""Item statistics of a stream of utility lines: TWU and utilities are sums, so they follow the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_item_stats(parsed: DataFrame) -> DataFrame:
    """(item, twu, riu, miu, mau, support) of a streaming table of whole transactions (items, utils, tu).

    Transactions come whole, so no state but one row an item is held. Items must not repeat in a transaction.
    """
    rows = parsed.select("tu", F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("utils").alias("util"))))
    return rows.groupBy("item").agg(F.sum("tu").alias("twu"), F.sum("util").alias("riu"), F.min("util").alias("miu"), F.max("util").alias("mau"), F.count("*").alias("support"))
