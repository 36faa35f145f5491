"""Lower bounds of the k-th utility, raised before the search.

Each strategy gives (itemset, bound) with bound <= utility of the itemset. The k-th largest bound over distinct
itemsets is at most the k-th utility; with fewer than k bounds nothing is known and the threshold is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import stats


def riu_bounds(items: DataFrame) -> DataFrame:
    return items.select(F.array("item").alias("itemset"), F.col("riu").alias("bound"))


def first_pair_bounds(lines: DataFrame, position: str = "item") -> DataFrame:
    return stats.first_pairs(lines, position).select(F.array("i", "j").alias("itemset"), F.col("utility").alias("bound"))


def pair_bounds(lines: DataFrame) -> DataFrame:
    return stats.pair_stats(lines).select(F.array("i", "j").alias("itemset"), F.col("utility").alias("bound"))


def node_bounds(rows: DataFrame) -> DataFrame:
    return stats.prefix_nodes(rows).select(F.array_sort("prefix").alias("itemset"), F.col("utility").alias("bound"))


def descendant_bounds(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(least utility of the root + of the item) times their common transactions."""
    low = items.select("item", "miu")
    pairs = stats.root_descendants(rows).join(low, "item").join(low.select(F.col("item").alias("root"), F.col("miu").alias("rmiu")), "root")
    return pairs.select(F.array_sort(F.array("root", "item")).alias("itemset"), ((F.col("miu") + F.col("rmiu")) * F.col("count")).alias("bound"))


def leaf_bounds(rows: DataFrame, removed: int = 3) -> DataFrame:
    """Runs, runs with items removed, and single items; itemsets are arrays of ranks."""
    riu = rows.groupBy("rank").agg(F.sum("util").alias("riu"))
    found = stats.runs(rows)
    whole = found.select(F.sequence("start", "finish").alias("itemset"), F.col("utility").alias("bound"))
    less = stats.run_bounds(found, riu, removed).select(F.array_except(F.sequence("start", "finish"), "gone").alias("itemset"), "bound")
    return whole.unionByName(less).unionByName(riu.select(F.array("rank").alias("itemset"), F.col("riu").alias("bound")))


def kth_bound(bounds: DataFrame, k: int) -> DataFrame:
    """(theta): one row. Only k rows are ordered at the end; each task keeps its own k largest."""
    top = bounds.filter("bound > 0").groupBy("itemset").agg(F.max("bound").alias("bound")).orderBy(F.col("bound").desc()).limit(k)
    return top.agg(F.when(F.count("*") >= k, F.min("bound")).otherwise(F.lit(0).cast("long")).alias("theta"))


def top_bounds(bounds: DataFrame, k: int) -> dict[tuple, int]:
    """The k largest bounds by itemset; k rows reach the driver."""
    rows = bounds.filter("bound > 0").groupBy("itemset").agg(F.max("bound").alias("bound")).orderBy(F.col("bound").desc()).limit(k).collect()
    return {tuple(r["itemset"]): r["bound"] for r in rows}


def kth_of(bounds: dict[tuple, int], k: int) -> int:
    return sorted(bounds.values(), reverse=True)[k - 1] if len(bounds) >= k else 0


def threshold(k: int, *bounds: DataFrame) -> int:
    return kth_bound(reduce(DataFrame.unionByName, bounds), k).first()["theta"]
