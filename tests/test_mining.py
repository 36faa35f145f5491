import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.api import topk_hui
from quarry.operators import stats as st
from quarry.operators import thresholds as th
from quarry.plans.projected import arrays
from quarry.sources.spmf import lines_of, metadata, parse_spmf, positions_of, read_spmf, spmf_text, write_result, write_spmf

SAMPLE = ["3 5 1 2 4 6:30:1 3 5 10 6 5", "3 5 2 4:20:3 3 8 6", "3 1 4:8:1 5 2", "3 5 1 7:27:6 6 10 5", "3 5 2 7:11:2 3 4 2"]


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def brute(tx):
    out = {}
    for t in tx:
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), n):
                u, c = out.get(s, (0, 0))
                out[s] = (u + sum(t[i] for i in s), c + 1)
    return sorted(((u, s, c) for s, (u, c) in out.items() if u > 0), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def sample(spark):
    return lines_of(parse_spmf(text(spark, SAMPLE))).cache()


def pairs(df, *cols):
    return {tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect()}


def test_item_statistics(sample):
    assert pairs(st.item_stats(sample), "item", "support", "twu", "riu", "miu", "mau") == {(6, 1, 30, 5, 5, 5), (7, 2, 38, 7, 2, 5), (4, 3, 58, 14, 2, 6), (2, 3, 61, 22, 4, 10), (1, 3, 65, 20, 5, 10), (5, 4, 88, 15, 3, 6), (3, 5, 96, 13, 1, 6)}


def test_utility_lists(sample):
    rows = st.utility_lists(st.ranked(sample))
    assert pairs(rows.groupBy("item", "rank").agg(F.sum("util").alias("u"), F.sum("rutil").alias("r")), "item", "rank", "u", "r") == {(6, 0, 5, 25), (7, 1, 7, 31), (4, 2, 14, 39), (2, 3, 22, 20), (1, 4, 20, 17), (5, 5, 15, 12), (3, 6, 13, 0)}


def test_pairs_and_first_pairs(spark, sample):
    found = pairs(st.pair_stats(sample), "i", "j", "utility", "twu", "support")
    assert len(found) == 19 and {(1, 3, 28, 65, 3), (3, 5, 27, 88, 4), (5, 7, 16, 38, 2)} <= found
    pe = st.first_pairs(positions_of(parse_spmf(text(spark, SAMPLE))), "pos")
    assert pairs(pe, "i", "j", "utility") == {(3, 5, 27), (1, 3, 28), (2, 3, 28), (3, 4, 19), (3, 6, 6), (3, 7, 15)}


def test_nodes_descendants_runs(sample):
    rows = st.ranked(sample)
    assert {((3,), 13, 5), ((3, 5), 27, 4), ((3, 5, 1), 31, 2), ((3, 5, 2, 7), 11, 1)} <= pairs(st.prefix_nodes(rows), "prefix", "utility", "count")
    md = {(tuple(x), b) for x, b in pairs(th.descendant_bounds(rows, st.item_stats(sample)), "itemset", "bound")}
    assert md == {((3, 5), 16), ((1, 3), 18), ((2, 3), 15), ((3, 4), 9), ((3, 6), 6), ((3, 7), 6)}
    found = st.runs(rows)
    assert pairs(found, "start", "finish", "utility") == {(2, 3, 30), (2, 4, 21), (2, 5, 24), (2, 6, 25), (3, 4, 15), (3, 5, 18), (3, 6, 19), (4, 5, 24), (4, 6, 31), (5, 6, 27)}
    less = st.run_bounds(found, rows.groupBy("rank").agg(F.sum("util").alias("riu"))).collect()
    assert max(r["bound"] for r in less) == 16
    assert [r for r in less if r["bound"] == 16][0]["gone"] == [5]


@pytest.mark.parametrize("k,riu,pe,cud,nu,md,leaf", [(1, 22, 28, 31, 31, 18, 31), (3, 15, 27, 28, 27, 15, 27), (8, 0, 0, 18, 19, 0, 21)])
def test_thresholds(spark, sample, k, riu, pe, cud, nu, md, leaf):
    rows, items = st.ranked(sample), st.item_stats(sample)
    order = positions_of(parse_spmf(text(spark, SAMPLE)))
    got = [th.threshold(k, x) for x in (th.riu_bounds(items), th.first_pair_bounds(order, "pos"), th.pair_bounds(sample), th.node_bounds(rows), th.descendant_bounds(rows, items), th.leaf_bounds(rows))]
    assert got == [riu, pe, cud, nu, md, leaf]


GOLD = [({2, 3, 4, 5}, 40), ({2, 3, 5}, 37), ({2, 4, 5}, 36), ({2, 3, 4}, 34), ({1, 3, 5}, 31), ({2, 5}, 31), ({1, 2, 3, 4, 5, 6}, 30), ({2, 4}, 30)]


@pytest.mark.parametrize("strategy", ["levelwise", "projected", "two_phase"])
def test_golden(sample, strategy):
    rows = topk_hui(sample, 8, strategy).rows.collect()
    assert [(set(r["itemset"]), r["utility"]) for r in rows] == GOLD
    assert len(topk_hui(sample, 5, strategy, "all").rows.collect()) == 6
    assert len(topk_hui(sample, 1000, strategy).rows.collect()) == 75


def test_groups_too_large_for_a_task_are_dealt_again(sample):
    rows = topk_hui(sample, 8, "projected", cells=3).rows.collect()
    assert [(set(r["itemset"]), r["utility"]) for r in rows] == GOLD


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strategies_agree_with_brute_force(spark, seed):
    r = random.Random(seed)
    tx = [{i: r.randrange(0, 9) for i in r.sample(range(8), r.randrange(1, 6))} for _ in range(25)]
    lines = spark.createDataFrame([(t, i, u) for t, x in enumerate(tx) for i, u in x.items()], "tid long, item long, util long")
    want, k = brute(tx), 12
    items, rows = st.item_stats(lines), st.ranked(lines)
    for bounds in (th.riu_bounds(items), th.first_pair_bounds(lines), th.pair_bounds(lines), th.node_bounds(rows), th.descendant_bounds(rows, items), th.leaf_bounds(rows)):
        assert th.threshold(k, bounds) <= want[k - 1][0]
    for strategy in ("levelwise", "projected", "two_phase"):
        got = [(x["utility"], tuple(x["itemset"]), x["support"]) for x in topk_hui(lines, k, strategy, raise_by=("riu", "pe", "cud", "nu", "md", "leaf")).rows.collect()]
        assert got == want[:k]


def test_merged_transactions_add(spark):
    lines = spark.createDataFrame([(t, i, t + i) for t in range(6) for i in (1, 2)], "tid long, item long, util long")
    rows = arrays(st.ranked(lines)).collect()
    assert len(rows) == 1 and rows[0]["many"] == 6 and sum(rows[0]["utils"]) == sum(2 * t + 3 for t in range(6))


def test_parsing(spark):
    bad = ["", "# c", "% c", "@ c", "1 2:5", "1 2:9:3", "1 x:5:2 3", "1 1 2:6:1 2 3", "1 2:1:5 5"]
    parsed = parse_spmf(text(spark, bad))
    assert sorted((r["items"], r["tu"]) for r in parsed.collect()) == [([1, 1, 2], 6), ([1, 2], 10)]
    assert pairs(lines_of(parsed).filter("item = 1"), "item", "util") == {(1, 3), (1, 5)}
    assert parse_spmf(text(spark, bad), trust_tu=True).filter("size(items) = 2").first()["tu"] == 1
    assert metadata(parsed).first().asDict() == {"max_item": 2, "transactions": 2}
    with pytest.raises(Exception, match="not a transaction"):
        parse_spmf(text(spark, bad), "failfast").collect()
    with pytest.raises(Exception, match="negative utility"):
        lines_of(parse_spmf(text(spark, ["1 2:1:-1 2"]))).collect()
    with pytest.raises(ValueError):
        topk_hui(lines_of(parsed), 0)


def test_edges(spark):
    zero = lines_of(parse_spmf(text(spark, ["1 2:3:0 3"])))
    assert [r["itemset"] for r in topk_hui(zero, 5).rows.collect()] == [[1, 2], [2]]
    alone = lines_of(parse_spmf(text(spark, ["1:5:5", "2:7:7"])))
    assert [r["utility"] for r in topk_hui(alone, 5).rows.collect()] == [7, 5]
    empty = lines_of(parse_spmf(text(spark, ["# none"])))
    for s in ("levelwise", "projected", "two_phase"):
        assert topk_hui(empty, 3, s).rows.count() == 0


def test_round_trip_and_result(spark, sample, tmp_path):
    write_spmf(sample, str(tmp_path / "db"))
    again = lines_of(read_spmf(spark, str(tmp_path / "db")))
    assert pairs(st.item_stats(again), "item", "twu", "riu") == pairs(st.item_stats(sample), "item", "twu", "riu")
    assert spmf_text(sample).count() == 5
    write_result(topk_hui(sample, 2).rows, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["2 3 4 5 #UTIL: 40", "2 3 5 #UTIL: 37"]


def test_streaming(spark, tmp_path):
    from quarry.streaming.incremental import streaming_item_stats

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(SAMPLE))
    found = streaming_item_stats(parse_spmf(spark.readStream.text(str(tmp_path / "in"))))
    q = found.writeStream.outputMode("complete").format("memory").queryName("item_stats").start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("item_stats").filter("item = 3"), "item", "twu", "riu", "support") == {(3, 96, 13, 5)}


@pytest.mark.parametrize("seed,cells", [(1, 10**6), (2, 40), (3, 40)])
def test_search_of_longer_transactions(spark, seed, cells):
    r = random.Random(seed)
    tx = [{i: r.randrange(0, 30) for i in r.sample(range(12), r.randrange(1, 9))} for _ in range(40)]
    lines = spark.createDataFrame([(t, i, u) for t, x in enumerate(tx) for i, u in x.items()], "tid long, item long, util long")
    want = brute(tx)
    for pair_filter in (True, False):
        got = topk_hui(lines, 25, "projected", cells=cells, pair_filter=pair_filter, raise_by=("riu",)).rows.collect()
        assert [(x["utility"], tuple(x["itemset"]), x["support"]) for x in got] == want[:25]


def test_verification_goes_in_rounds(sample):
    found = topk_hui(sample, 2, "two_phase", first=1, raise_by=("riu",))
    assert [r["utility"] for r in found.rows.collect()] == [40, 37]
    assert found.stats["rounds"] > 1 and found.stats["verified"] <= found.stats["candidates"] and found.stats["theta_search"] == 37


def test_stats_name_each_threshold(sample):
    stats = topk_hui(sample, 3, raise_by=("riu", "pe", "cud", "nu", "md", "leaf")).stats
    assert (stats["theta_riu"], stats["theta_cud"], stats["theta_nu"], stats["theta_leaf"]) == (15, 28, 27, 27)
    assert stats["theta_items"] == 30 == stats["theta_start"] and stats["theta_search"] <= 36 and stats["seconds_search"] >= 0


def test_ranks_keep_the_order_of_twu(sample):
    rows = sorted((r["rank"], r["item"]) for r in st.names_of(st.item_stats(sample), 60).collect())
    assert [i for _, i in rows] == [2, 1, 5, 3]


def test_command(spark, tmp_path, capsys):
    from quarry.__main__ import main

    (tmp_path / "db.txt").write_text("\n".join(SAMPLE))
    for n, more in enumerate((["-s", "levelwise", "--no-eucs-prune"], ["-r", "riu", "cud"], ["-s", "two_phase", "--ties", "all"])):
        assert main(["-i", str(tmp_path / "db.txt"), "-o", str(tmp_path / f"out{n}"), "-k", "2", *more]) == 0
        assert [r["value"] for r in spark.read.text(str(tmp_path / f"out{n}")).collect()] == ["2 3 4 5 #UTIL: 40", "2 3 5 #UTIL: 37"]
    assert "driver_heap_mb" in capsys.readouterr().out
    assert main(["-i", str(tmp_path / "none.txt"), "-o", str(tmp_path / "x")]) == 1


def test_package_is_sent_to_executors(spark, sample):
    topk_hui(sample, 2)
    assert "quarry.zip" in spark.sparkContext._python_includes
