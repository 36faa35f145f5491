"""Level-wise mining: one join and one aggregation a level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.stats import pair_stats, utility_lists
from quarry.plans.common import cut, raised


def measure(lists: DataFrame) -> DataFrame:
    """(ranks, utility, bound, support): a set's utility, and a bound for all that extend it."""
    return lists.groupBy("ranks").agg(F.sum("iutil").alias("utility"), F.sum(F.col("iutil") + F.col("rutil")).alias("bound"), F.count("*").alias("support"))


def extend(lists: DataFrame, lines: DataFrame, keep: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Lists of the sets in `keep`, each with one item of higher rank; pairs: (i, j) that a last and a new item may form.

    Lines of single items are joined by transaction, so the utility of the common part is never counted twice.
    """
    if keep is not None:
        lists = lists.join(keep.select("ranks"), "ranks", "left_semi")
    right = lines.select("tid", F.col("rank").alias("new"), "util", F.col("rutil").alias("after"))
    both = lists.join(right, "tid").filter(F.col("new") > F.col("last"))
    if pairs is not None:
        both = both.join(pairs.select(F.col("i").alias("last"), F.col("j").alias("new")), ["last", "new"], "left_semi")
    return both.select(F.concat("ranks", F.array("new")).alias("ranks"), F.col("new").alias("last"), "tid", (F.col("iutil") + F.col("util")).alias("iutil"), F.col("after").alias("rutil"))


def singles(lines: DataFrame) -> DataFrame:
    return lines.select(F.array("rank").alias("ranks"), F.col("rank").alias("last"), "tid", F.col("util").alias("iutil"), "rutil")


def mine(rows: DataFrame, k: int, theta: int, pair_filter: bool = True, stats: dict | None = None) -> DataFrame:
    """(ranks, utility, support) of all sets that reach the k-th utility, and some that do not."""
    stats = {} if stats is None else stats
    rows = cut(rows)
    lines = cut(utility_lists(rows))
    lists, found, levels, best = singles(lines), [], 0, []
    pairs = cut(pair_stats(rows, "rank").filter(F.col("twu") >= theta)) if pair_filter else None
    while True:
        levels += 1
        sets = cut(measure(lists))
        found.append(sets.filter(F.col("utility") >= theta).select("ranks", "utility", "support"))
        best, theta = raised(best, found[-1], "utility", k, theta)
        keep = sets.filter(F.col("bound") >= theta)
        n = sets.agg(F.count("*").alias("all"), F.count_if(F.col("bound") >= theta).alias("kept")).first()
        stats["candidates"] = stats.get("candidates", 0) + n["all"]
        if not n["kept"]:
            break
        lists = cut(extend(lists, lines, keep, pairs))
    stats |= {"levels": levels, "theta_search": theta}
    return reduce(DataFrame.unionByName, found).filter(F.col("utility") >= theta)
