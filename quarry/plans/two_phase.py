"""Candidate and verify: sets by upper bounds first, then exact utilities in rounds from the largest estimate down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.common import cut, kth, raised

#: Candidates of the first round, for each of the k wanted; each round takes four times as many.
FIRST, AT_MOST = 4, 1_000_000


def candidates(rows: DataFrame, theta: int, stats: dict | None = None, k: int | None = None) -> DataFrame:
    """(ranks, estimate, floor): sets whose TWU reaches theta, and whose summed largest utilities times support do.

    floor is what the set holds at least: its items' least utilities times support. With k, the k-th largest floor
    so far raises theta after each level.
    """
    each = rows.groupBy("rank").agg(F.max("util").alias("mau"), F.min("util").alias("miu"))
    lines = cut(rows.select("tid", "rank", "tu").join(each, "rank"))
    level = lines.select(F.array("rank").alias("ranks"), F.col("rank").alias("last"), "tid", "tu", F.col("mau").alias("most"), F.col("miu").alias("least"))
    right = lines.select("tid", F.col("rank").alias("new"), "mau", "miu")
    out, levels, best = [], 0, []
    while True:
        levels += 1
        sets = cut(level.groupBy("ranks").agg(F.sum("tu").alias("twu"), F.count("*").alias("n"), F.max("most").alias("most"), F.max("least").alias("least")).filter(F.col("twu") >= theta))
        estimate = F.least("twu", F.col("most") * F.col("n"))
        out.append(sets.select("ranks", estimate.alias("estimate"), (F.col("least") * F.col("n")).alias("floor")).filter(F.col("estimate") >= theta))
        if k is not None:
            best, theta = raised(best, out[-1], "floor", k, theta)
        keep = sets.filter(F.col("twu") >= theta)
        if not keep.head(1):
            break
        kept = level.join(keep.select("ranks"), "ranks", "left_semi").join(right, "tid").filter("new > last")
        level = cut(kept.select(F.concat("ranks", F.array("new")).alias("ranks"), F.col("new").alias("last"), "tid", "tu", (F.col("most") + F.col("mau")).alias("most"), (F.col("least") + F.col("miu")).alias("least")))
    if stats is not None:
        stats |= {"levels": levels, "theta_mc": theta}
    return reduce(DataFrame.unionByName, out).filter(F.col("estimate") >= theta)


def verify(sets: DataFrame, lines: DataFrame, item: str = "rank") -> DataFrame:
    """(ranks, utility, support): each set's items meet the lines; transactions that hold all of them are summed."""
    wanted = sets.select("ranks", F.size("ranks").alias("size"), F.explode("ranks").alias(item))
    whole = wanted.join(lines.select("tid", item, "util"), item).groupBy("ranks", "size", "tid").agg(F.sum("util").alias("u"), F.count("*").alias("n")).filter("n = size")
    return whole.groupBy("ranks").agg(F.sum("u").alias("utility"), F.count("*").alias("support"))


def mine(rows: DataFrame, k: int, theta: int, first: int = FIRST, stats: dict | None = None) -> DataFrame:
    """Each round verifies the candidates of largest estimate; the k-th exact utility drops those below it unverified."""
    stats = {} if stats is None else stats
    rows = cut(rows)
    sets = cut(candidates(rows, theta, stats, k))
    theta = max(theta, stats["theta_mc"])
    found, below, wanted, rounds, verified = [], None, first * k, 0, 0
    while True:
        left = sets.filter(F.col("estimate") >= theta)
        left = left if below is None else left.filter(F.col("estimate") < below)
        ahead = left.select("estimate").orderBy(F.col("estimate").desc()).limit(wanted).agg(F.count("*").alias("n"), F.min("estimate").alias("low")).first()
        if not ahead["n"]:
            break
        more = ahead["n"] == wanted < AT_MOST  # beyond that the rest is one round
        now = left.filter(F.col("estimate") >= ahead["low"]) if more else left
        found.append(cut(verify(now, rows).filter(F.col("utility") >= theta)))
        theta = kth(reduce(DataFrame.unionByName, found), k, theta)
        rounds, verified = rounds + 1, verified + ahead["n"]
        if not more:
            break
        below, wanted = ahead["low"], 4 * wanted
    stats |= {"candidates": sets.count(), "verified": verified, "rounds": rounds, "theta_search": theta}
    if not found:
        return verify(sets, rows)
    return reduce(DataFrame.unionByName, found).filter(F.col("utility") >= theta)
