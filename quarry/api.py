"""topk_hui: the k itemsets of largest utility."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import stats as st
from quarry.operators import thresholds as th
from quarry.plans import levelwise, projected, two_phase
from quarry.plans.common import cut, named, top

STRATEGIES = {"levelwise": levelwise.mine, "projected": projected.mine, "two_phase": two_phase.mine}

@dataclass
class MiningResult:
    rows: DataFrame
    stats: dict = field(default_factory=dict)


def topk_hui(lines: DataFrame, k: int, strategy: str = "projected", ties: str = "exact", raise_by: tuple[str, ...] | None = None, **options) -> MiningResult:
    """(itemset, utility, support) of the k sets of items with the largest utility in lines (tid, item, util).

    Items may be of any type that can be ordered. Sets of utility 0 are not returned, nor sets that no transaction
    holds. ties: "exact" returns k rows, smaller itemsets first among equals; "all" adds what ties with the k-th.
    raise_by: the strategies that raise the threshold before the search (riu, pe, cud, nu, md, leaf). By default riu
    is one, and cud where items are so few that pairs of them must repeat, but not where the lines are few enough for
    a task's search to find as much by itself; they only raise the threshold.
    stats say the thresholds of each strategy, what was measured on the way, and seconds on the driver's clock.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r}")
    began = time.time()
    lines = cut(st.with_tu(lines.groupBy("tid", "item").agg(F.sum("util").alias("util"))))
    items = cut(st.item_stats(lines))
    size = items.agg(F.count("*").alias("items"), F.sum("support").alias("lines")).first()
    found: dict = {"items": size["items"], "lines": size["lines"] or 0}
    bounds: dict[tuple, int] = {}
    few = strategy == "projected" and found["lines"] <= projected.CELLS
    for name in raise_by or (() if few or size["items"] ** 2 > 2 * found["lines"] else ("cud",)):
        if name == "riu":
            continue
        if name == "pe":
            now = th.top_bounds(th.first_pair_bounds(lines), k)
        elif name == "cud":
            now = th.top_bounds(th.pair_bounds(lines), k)
        elif name in ("nu", "md", "leaf"):
            rows = st.ranked(lines)
            if name == "leaf":  # of ranks, so it is not united with the others
                found["theta_leaf"] = th.threshold(k, th.leaf_bounds(rows))
                continue
            now = th.top_bounds(th.node_bounds(rows) if name == "nu" else th.descendant_bounds(rows, items), k)
        else:
            raise ValueError(f"threshold {name!r}")
        found[f"theta_{name}"] = th.kth_of(now, k)
        bounds = {x: max(now.get(x, 0), bounds.get(x, 0)) for x in now | bounds}
    if raise_by is None or "riu" in raise_by:
        now = {(r["item"],): r["riu"] for r in items.filter("riu > 0").orderBy(F.col("riu").desc()).limit(k).collect()}
        found["theta_riu"] = th.kth_of(now, k)
        bounds |= {x: max(u, bounds.get(x, 0)) for x, u in now.items()}
    found["theta_items"] = th.kth_of(bounds, k)
    theta = max(1, found["theta_items"], found.get("theta_leaf", 0))
    names = cut(st.names_of(items, theta))
    rows = st.with_tu(lines.join(names, "item").select("tid", "rank", "item", "util"))
    middle = time.time()
    sets = STRATEGIES[strategy](rows, k, theta, stats=found, **options)
    found |= {"seconds_thresholds": round(middle - began, 3), "seconds_search": round(time.time() - middle, 3)}
    return MiningResult(top(named(sets, names), k, ties), {"theta_start": theta} | found)
