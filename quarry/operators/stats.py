"""Statistics of utility lines (tid, item, util): each is one or two aggregations with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_tu(lines: DataFrame) -> DataFrame:
    """Lines with their transaction's utility; the window needs lines by tid only, as all that follows."""
    return lines.withColumn("tu", F.sum("util").over(W.partitionBy("tid")))


def item_stats(lines: DataFrame) -> DataFrame:
    """(item, twu, riu, miu, mau, support)."""
    lines = lines if "tu" in lines.columns else with_tu(lines)
    return lines.groupBy("item").agg(F.sum("tu").alias("twu"), F.sum("util").alias("riu"), F.min("util").alias("miu"), F.max("util").alias("mau"), F.count("*").alias("support"))


def ranked(lines: DataFrame, theta: int = 0) -> DataFrame:
    """(tid, rank, item, util, tu): promising items, ranked by (TWU, item) ascending from 0.

    The rank is taken over the item table, one row an item; where it is small Spark broadcasts it to the lines.
    """
    order = item_stats(lines).filter(F.col("twu") >= theta).select("item", (F.row_number().over(W.orderBy("twu", "item")) - 1).cast("int").alias("rank"))
    return with_tu(lines.join(order, "item").select("tid", "rank", "item", "util"))


def names_of(items: DataFrame, theta: int = 0) -> DataFrame:
    """(item, rank) of the promising items: ranks ascend with (TWU, item), with gaps between a sort's partitions.

    The sort is by range, so no task holds all items. Cut it before it is used twice.
    """
    return items.filter(F.col("twu") >= theta).orderBy("twu", "item").select("item", F.monotonically_increasing_id().alias("rank"))


def utility_lists(rows: DataFrame) -> DataFrame:
    """Adds rutil: the utility of the items of higher rank in the transaction."""
    after = W.partitionBy("tid").orderBy("rank").rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn("rutil", F.coalesce(F.sum("util").over(after), F.lit(0).cast("long")))


def pair_stats(rows: DataFrame, order: str = "item") -> DataFrame:
    """(i, j, utility, twu, support) of the pairs i < j that occur together.

    Pairs are made from each transaction's sorted array, so lines meet by the shuffle that collects them and no
    join of lines with themselves is needed; a transaction of n items has n(n-1)/2 pairs.
    """
    rows = rows if "tu" in rows.columns else with_tu(rows)
    tx = rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "util"))).alias("x"), F.first("tu").alias("tu"))
    left = tx.select("tu", "x", F.posexplode("x").alias("p", "a"))
    both = left.select("tu", "a", F.explode(F.expr("slice(x, p + 2, size(x))")).alias("b"))
    return both.groupBy(F.col("a.o").alias("i"), F.col("b.o").alias("j")).agg(F.sum(F.col("a.util") + F.col("b.util")).alias("utility"), F.sum("tu").alias("twu"), F.count("*").alias("support"))


def first_pairs(lines: DataFrame, position: str = "item") -> DataFrame:
    """(i, j, utility): each transaction's first item with every later one; a lower bound of the pair's utility."""
    w = W.partitionBy("tid").orderBy(position)
    rows = lines.select("tid", "item", "util", F.first("item").over(w).alias("fi"), F.first("util").over(w).alias("fu")).filter("item <> fi")
    return rows.groupBy(F.least("fi", "item").alias("i"), F.greatest("fi", "item").alias("j")).agg(F.sum(F.col("fu") + F.col("util")).alias("utility"))


def prefix_nodes(rows: DataFrame) -> DataFrame:
    """(prefix, utility, count): the nodes of the prefix tree of transactions in descending rank."""
    w = W.partitionBy("tid").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(F.collect_list("item").over(w).alias("prefix"), F.sum("util").over(w).alias("cum")).groupBy("prefix").agg(F.sum("cum").alias("utility"), F.count("*").alias("count"))


def root_descendants(rows: DataFrame) -> DataFrame:
    """(root, item, count): items below each root child of that tree."""
    w = W.partitionBy("tid").orderBy(F.col("rank").desc())
    return rows.select("item", F.first("item").over(w).alias("root")).filter("item <> root").groupBy("root", "item").agg(F.count("*").alias("count"))


def runs(rows: DataFrame) -> DataFrame:
    """(start, finish, utility): runs of 2 or more items of adjacent rank that occur together; ranks without gaps."""
    w = W.partitionBy("tid").orderBy("rank")
    rows = rows.select("tid", "rank", "util", (F.col("rank") - F.row_number().over(w)).alias("island"))
    tx = rows.groupBy("tid", "island").agg(F.array_sort(F.collect_list(F.struct("rank", "util"))).alias("x"))
    starts = tx.select("x", F.posexplode("x").alias("p", "a")).select("a", F.expr("slice(x, p + 1, size(x))").alias("run"))
    ends = starts.filter("size(run) > 1").select(F.col("a.rank").alias("start"), "run", F.explode(F.expr("sequence(2, size(run))")).alias("n"))
    total = F.expr("aggregate(slice(run, 1, n), 0L, (s, x) -> s + x.util)")
    return ends.select("start", (F.col("start") + F.col("n") - 1).alias("finish"), total.alias("util")).groupBy("start", "finish").agg(F.sum("util").alias("utility"))


def run_bounds(found: DataFrame, riu: DataFrame, removed: int = 3) -> DataFrame:
    """(start, finish, gone, bound): a run's utility less the whole utility of 1 to `removed` items within it.

    riu has (rank, riu), one row an item. A run of n items has about n ** removed / 6 such choices.
    """
    inner = found.filter("finish - start > 1").select("start", "finish", "utility", F.explode(F.expr("sequence(start + 1, finish - 1)")).alias("rank"))
    inner = inner.join(riu, "rank").groupBy("start", "finish", "utility").agg(F.array_sort(F.collect_list(F.struct("rank", "riu"))).alias("x"))
    rows = inner.select("start", "finish", "utility", "x", F.expr("cast(array() as array<int>)").alias("gone"), F.col("utility").alias("bound"), F.lit(0).alias("from"))
    out = None
    for _ in range(removed):
        picks = F.expr("filter(transform(x, (e, i) -> struct(i as i, e.rank as rank, e.riu as riu)), e -> e.i >= from)")
        rows = rows.select("start", "finish", "utility", "x", "gone", "bound", F.explode(picks).alias("e"))
        rows = rows.select("start", "finish", "utility", "x", F.concat("gone", F.array(F.col("e.rank").cast("int"))).alias("gone"), (F.col("bound") - F.col("e.riu")).alias("bound"), (F.col("e.i") + 1).alias("from"))
        now = rows.select("start", "finish", "gone", "bound")
        out = now if out is None else out.unionByName(now)
    return out.filter("bound > 0")
