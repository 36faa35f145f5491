"""Projected mining: a group for each first item, searched depth first where it fits in a task.

A set belongs to the group of its item of lowest rank, so groups share nothing but the threshold. Where all groups
together fit in a task's measure (`cells` items) they are dealt as they are. Else each is measured by an aggregation
first; a group of more than `cells` items is not given to a task, but dealt again by the next item, until groups fit.
Transactions with equal items are merged first where that halves them: utilities add. Only what follows an item is
sent to its group.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.common import cut, kth, ship

CELLS = 1_000_000
FOUND = "ranks array<long>, utility long, support long"


def arrays(rows: DataFrame, merge: bool | None = None) -> DataFrame:
    """(ranks, utils, many): transactions as arrays by rank, `many` alike in one."""
    return _arrays(rows, merge)[0]


def _arrays(rows: DataFrame, merge: bool | None = None) -> tuple[DataFrame, int]:
    """The transactions, and how many items all their suffixes have."""
    x = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "util")))
    tx = cut(rows.groupBy("tid").agg(x.alias("x")).select(F.col("x.rank").alias("ranks"), F.col("x.util").alias("utils"), F.lit(1).cast("long").alias("many")))
    size = F.size("ranks").cast("long")
    n = tx.agg(F.count("*").alias("n"), F.approx_count_distinct("ranks").alias("d"), F.sum(size * (size + 1) / 2).cast("long").alias("cells")).first()
    if merge is None:
        merge = n["d"] * 2 < n["n"]
    if merge:
        each = tx.select("ranks", F.posexplode("utils").alias("p", "u")).groupBy("ranks", "p").agg(F.sum("u").alias("u"), F.count("*").alias("many"))
        tx = each.groupBy("ranks").agg(F.array_sort(F.collect_list(F.struct("p", "u"))).alias("x"), F.max("many").alias("many")).select("ranks", F.col("x.u").alias("utils"), "many")
    return tx, n["cells"] or 0


def heads(tx: DataFrame) -> DataFrame:
    """Rows (prefix, own, ranks, utils, many) once for each of their items, with its place p and rank r."""
    return tx.select("prefix", "own", "ranks", "utils", "many", F.posexplode("ranks").alias("p", "r"))


def measured(each: DataFrame) -> DataFrame:
    """(ranks, utility, bound, support, n) of each head's group: n items would be dealt to it."""
    here, after = F.col("own") + F.expr("utils[p]"), F.expr("aggregate(slice(utils, p + 2, size(utils)), 0L, (a, x) -> a + x)")
    rows = each.select("prefix", "r", here.alias("here"), (here + after).alias("most"), "many", (F.size("ranks") - F.col("p")).alias("n"))
    groups = rows.groupBy("prefix", "r").agg(F.sum("here").alias("utility"), F.sum("most").alias("bound"), F.sum("many").alias("support"), F.sum("n").alias("n"))
    return groups.select("prefix", "r", F.concat("prefix", F.array("r")).alias("ranks"), "utility", "bound", "support", "n")


def deal(each: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of the wanted heads, or of all: prefix, what it holds already, and what may follow."""
    own, after = F.col("own") + F.expr("utils[p]"), [F.expr(f"slice({c}, p + 2, size({c}))").alias(c) for c in ("ranks", "utils")]
    each = each.select("prefix", "r", own.alias("own"), *after, "many")  # before rows are sent
    if wanted is not None:
        each = each.join(wanted.select("prefix", "r"), ["prefix", "r"], "left_semi")
    return each.select(F.concat("prefix", F.array("r")).alias("prefix"), "own", "ranks", "utils", "many")


class Best:
    """The sets found, and the least utility that another needs: theta, or the k-th found if that is more."""

    def __init__(self, k: int, theta: int):
        self.k, self.least = k, theta
        self.found: list[tuple[list[int], int, int]] = []
        self._best: list[int] = []

    def take(self, ranks: list[int], utility: int, support: int) -> None:
        if utility < self.least:
            return
        self.found.append((ranks, utility, support))
        if len(self._best) < self.k:
            heapq.heappush(self._best, utility)
        elif utility > self._best[0]:
            heapq.heapreplace(self._best, utility)
        if len(self._best) == self.k:
            self.least = max(self.least, self._best[0])


def after_each(util: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place of rows [begin, end) that follow each other, the utility of what follows it in its row."""
    total = np.concatenate([[0], np.cumsum(util)])
    return np.repeat(total[end], end - begin) - total[1:]


def search(best: Best, prefix: list[int], rank: np.ndarray, util: np.ndarray, rest: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray, many: np.ndarray, pair_filter: bool = True) -> None:
    """Takes the group's sets that may be among the k largest, depth first over utility lists.

    A row of the group is the places [begin, end) of rank, util and rest, by rank, and what it holds of the prefix.
    All extensions of a set are measured at once. An item is grown only if what it has and what follows reaches the
    threshold, and it may follow a set only if the rows that hold both, from the set on, reach it (`ahead`): rows
    that lack the item are left out of the set's bound, and no more can be left of a pair than its TWU. Items that
    may not follow are taken out of the rows, so they are not counted as what follows either.
    """
    best.take(prefix, int(own.sum()), int(many.sum()))
    stack = [(prefix, None, rank, util, rest, begin, end, own, many)]
    while stack:
        path, bound, rank, util, rest, begin, end, own, many = stack.pop()
        fresh = True
        while bound is None or bound >= best.least:
            n = end - begin
            row = np.repeat(np.arange(len(n)), n)
            if not len(row):
                break
            place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(row))
            order = np.argsort(rank[place], kind="stable")
            at, in_row = place[order], row[order]
            r = rank[at]
            new = np.append(True, r[1:] != r[:-1])
            edge = np.flatnonzero(new)
            here = own[in_row] + util[at]
            utility = np.add.reduceat(here, edge)
            most = utility + np.add.reduceat(rest[at], edge)
            if fresh:
                support = np.add.reduceat(many[in_row], edge)
                for i in np.flatnonzero(utility >= best.least).tolist():
                    best.take([*path, int(r[edge[i]])], int(utility[i]), int(support[i]))
                if pair_filter:
                    some = np.minimum(begin, len(rank) - 1)
                    whole = own + np.where(n > 0, util[some] + rest[some], 0)
                    ahead = np.add.reduceat(whole[in_row], edge) >= best.least
                    if not ahead.all():
                        stays = np.empty(len(row), bool)
                        stays[order] = ahead[np.cumsum(new) - 1]
                        rank, util, row = rank[place[stays]], util[place[stays]], row[stays]
                        end = np.cumsum(np.bincount(row, minlength=len(n)))
                        begin = np.append(0, end[:-1])
                        rest = after_each(util, begin, end)
                        fresh = False
                        continue
            grown = np.flatnonzero(most >= best.least)
            ends = np.append(edge[1:], len(r))
            for i in grown[np.argsort(most[grown], kind="stable")].tolist():  # the largest comes off the stack first
                a, z = edge[i], ends[i]
                stack.append(([*path, int(r[a])], int(most[i]), rank, util, rest, at[a:z] + 1, end[in_row[a:z]], here[a:z], many[in_row[a:z]]))
            break


def mine(rows: DataFrame, k: int, theta: int, cells: int = CELLS, merge: bool | None = None, pair_filter: bool = True, stats: dict | None = None) -> DataFrame:
    """(ranks, utility, support) of all sets that reach the k-th utility, and some that do not."""
    stats = {} if stats is None else stats
    ship(rows.sparkSession)
    tx, total = _arrays(rows, merge)
    tx = tx.select(F.expr("cast(array() as array<long>)").alias("prefix"), F.lit(0).cast("long").alias("own"), "ranks", "utils", "many")
    found, levels = [], 0

    def run(groups: pa.Table) -> pa.Table:
        """A bucket of groups: small ones share a call, and what they find raises the threshold for the next."""
        groups = groups.combine_chunks()
        column = {c: groups.column(c).chunk(0) for c in groups.column_names} if len(groups) else {}
        offsets = np.asarray(column["ranks"].offsets, dtype=np.int64)
        begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        rank, util = (column[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ranks", "utils"))
        rest = after_each(util, begin, end)
        own, many, key = (column[c].to_numpy() for c in ("own", "many", "key"))
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])).tolist()
        parts = [order[a:z] for a, z in zip(edges, [*edges[1:], len(order)], strict=True)]
        whole = own + np.where(end > begin, util[np.minimum(begin, max(0, len(util) - 1))] + rest[np.minimum(begin, max(0, len(util) - 1))], 0) if len(util) else own
        best = Best(k, theta)
        for i in sorted(parts, key=lambda i: -int(whole[i].sum())):
            if int(whole[i].sum()) >= best.least:
                search(best, column["prefix"][int(i[0])].as_py(), rank, util, rest, begin[i], end[i], own[i], many[i], pair_filter)
        out = [x for x in best.found if x[1] >= best.least]
        return pa.table({"ranks": pa.array([x[0] for x in out], pa.list_(pa.int64())), "utility": pa.array([x[1] for x in out], pa.int64()), "support": pa.array([x[2] for x in out], pa.int64())})

    def searched(dealt: DataFrame, n: int) -> DataFrame:
        buckets = max(1, -(-4 * n // cells), 2 * tx.sparkSession.sparkContext.defaultParallelism)
        dealt = dealt.withColumn("key", F.xxhash64("prefix")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
        return cut(dealt.groupBy("bucket").applyInArrow(run, FOUND))

    while True:
        levels += 1
        each = heads(tx)
        if total <= cells:  # then every group is
            found.append(searched(deal(each), total))
            break
        groups = cut(measured(each))
        theta = kth(groups, k, theta)
        live = groups.filter(F.col("bound") >= theta)
        large = live.filter(F.col("n") > cells)
        fit = live.filter(F.col("n") <= cells)
        found.append(searched(deal(each, fit), fit.agg(F.sum("n")).first()[0] or 0))
        found.append(large.select("ranks", "utility", "support"))
        theta = kth(reduce(DataFrame.unionByName, found), k, theta)
        if not large.head(1):
            break
        tx = cut(deal(each, large))
        size = F.size("ranks").cast("long")
        total = tx.agg(F.sum(size * (size + 1) / 2).cast("long")).first()[0] or 0
    stats |= {"levels": levels, "theta_search": theta}
    return reduce(DataFrame.unionByName, found).filter(F.col("utility") >= theta)
