"""The registered queries on baskets of the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.api import topk_hui
from quarry.functions.itemsets import render, result_line
from quarry.operators import stats as st
from quarry.operators import thresholds as th
from quarry.plans import levelwise, two_phase
from quarry.plans.common import cut, named
from quarry.sources.baskets import baskets, transactions
from quarry.sources.spmf import lines_of, parse_spmf, spmf_text

K = 10


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cust_ptype(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return baskets(rows, F.col("o_custkey"), F.col("p_type"), F.col("l_extendedprice"))


def order_ptype(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return baskets(rows, F.col("l_orderkey"), F.col("p_type"), F.col("l_extendedprice"))


def order_part(spark: SparkSession, d: str) -> DataFrame:
    return baskets(table(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_extendedprice"))


def userday_event(spark: SparkSession, d: str) -> DataFrame:
    return baskets(table(spark, d, "events"), F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")), F.col("event_type"), F.col("value"))


def nation_brand(spark: SparkSession, d: str) -> DataFrame:
    """Baskets of 25 part brands by the 25 nations of customers: long transactions with long runs."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return baskets(rows, F.col("c_nationkey"), F.col("p_brand"), F.col("l_extendedprice"))


def _cents(c: str) -> str:
    return f"CAST(SUM(CAST(ROUND({c} * 100) AS BIGINT)) AS BIGINT)"


BASKET_SQL = {
    "cust_ptype": f"SELECT o_custkey AS tid, p_type AS item, {_cents('l_extendedprice')} AS util FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "order_ptype": f"SELECT l_orderkey AS tid, p_type AS item, {_cents('l_extendedprice')} AS util FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "order_part": f"SELECT l_orderkey AS tid, l_partkey AS item, {_cents('l_extendedprice')} AS util FROM lineitem GROUP BY 1, 2",
    "userday_event": f"SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS tid, event_type AS item, {_cents('value')} AS util FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
}
BASKET_SQL["nation_brand"] = f"SELECT c_nationkey AS tid, p_brand AS item, {_cents('l_extendedprice')} AS util FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
BASKETS = {"cust_ptype": cust_ptype, "order_ptype": order_ptype, "order_part": order_part, "userday_event": userday_event}
_TU = "t AS (SELECT tid, CAST(SUM(util) AS BIGINT) AS tu FROM b GROUP BY 1)"
_STATS = "s AS (SELECT item, CAST(SUM(tu) AS BIGINT) AS twu, CAST(SUM(util) AS BIGINT) AS riu, MIN(util) AS miu, MAX(util) AS mau, COUNT(*) AS support FROM b JOIN t USING (tid) GROUP BY 1)"
_RANKED = "r AS (SELECT tid, item, util, tu, rank FROM b JOIN t USING (tid) JOIN (SELECT item, ROW_NUMBER() OVER (ORDER BY twu, item) - 1 AS rank FROM s) USING (item))"
_UL = "ul AS (SELECT *, CAST(COALESCE(SUM(util) OVER (PARTITION BY tid ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS rutil FROM r)"


def _sql(basket: str, *parts: str, then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([f'b AS ({BASKET_SQL[basket]})', *parts])} {then}"


def _sets_sql(basket: str) -> tuple[str, str]:
    grown = "g(tid, itemset, last, util) AS (SELECT tid, CAST(item AS VARCHAR), item, util FROM b UNION ALL SELECT g.tid, g.itemset || ' ' || CAST(b.item AS VARCHAR), b.item, CAST(g.util + b.util AS BIGINT) FROM g JOIN b ON g.tid = b.tid AND b.item > g.last)"
    return grown, "e AS (SELECT itemset, CAST(SUM(util) AS BIGINT) AS utility, COUNT(*) AS support FROM g GROUP BY 1)"


def _top_sql(basket: str, k: int = K) -> str:
    return _sql(basket, *_sets_sql(basket), then=f"SELECT itemset, utility, support FROM e ORDER BY utility DESC, itemset LIMIT {k}", recursive=True)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(render(F.col("itemset")).alias("itemset"), "utility", "support")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _mined(strategy: str, basket: str, k: int = K):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(topk_hui(BASKETS[basket](spark, d), k, strategy).rows)

    query(_top_sql(basket, k), f"topk_{strategy}_{basket}")(run)


for _b in ("cust_ptype", "order_ptype", "userday_event"):
    _mined("levelwise", _b)
for _b in BASKETS:
    _mined("projected", _b)
for _b in ("cust_ptype", "order_ptype"):
    _mined("two_phase", _b)


@query(_sql("order_part", _TU, then="SELECT tid, tu, COUNT(*) AS n FROM t JOIN b USING (tid) GROUP BY 1, 2"))
def tx_utility(spark, d):
    return transactions(order_part(spark, d)).select("tid", "tu", "n")


def _item_query(name: str, *columns: str):
    @query(_sql("order_part", _TU, _STATS, then=f"SELECT item, {', '.join(columns)} FROM s"), name)
    def run(spark, d):
        return st.item_stats(order_part(spark, d)).select("item", *columns)


_item_query("item_twu", "twu")
_item_query("item_riu", "riu")
_item_query("item_miu_mau", "miu", "mau")
_item_query("item_support", "support")


@query(_sql("order_part", _TU, then="SELECT MAX(item) AS max_item, (SELECT COUNT(*) FROM t) AS transactions FROM b"))
def db_metadata(spark, d):
    lines = order_part(spark, d)
    return lines.agg(F.max("item").alias("max_item"), F.countDistinct("tid").alias("transactions"))


@query(_sql("order_part", _TU, then="SELECT x.item AS i, y.item AS j, CAST(SUM(x.util + y.util) AS BIGINT) AS utility, CAST(SUM(tu) AS BIGINT) AS twu, COUNT(*) AS support FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item JOIN t ON t.tid = x.tid GROUP BY 1, 2"))
def pair_eucs(spark, d):
    return st.pair_stats(order_part(spark, d))


_PE = "f AS (SELECT tid, MIN(item) AS fi, CAST(arg_min(util, item) AS BIGINT) AS fu FROM b GROUP BY 1), pe AS (SELECT LEAST(fi, item) AS i, GREATEST(fi, item) AS j, CAST(SUM(fu + util) AS BIGINT) AS utility FROM b JOIN f USING (tid) WHERE item <> fi GROUP BY 1, 2)"


@query(_sql("order_part", _PE, then="SELECT i, j, utility FROM pe"))
def pe_pairs(spark, d):
    return st.first_pairs(order_part(spark, d))


_NU = "p AS (SELECT string_agg(CAST(item AS VARCHAR), ' ') OVER w AS prefix, SUM(util) OVER w AS cum FROM r WINDOW w AS (PARTITION BY tid ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), nu AS (SELECT prefix, CAST(SUM(cum) AS BIGINT) AS utility, COUNT(*) AS count FROM p GROUP BY 1)"


@query(_sql("order_part", _TU, _STATS, _RANKED, _NU, then="SELECT prefix, utility, count FROM nu"))
def nu_prefix_nodes(spark, d):
    rows = st.prefix_nodes(st.ranked(order_part(spark, d)))
    return rows.select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), " ").alias("prefix"), "utility", "count")


_MD = "q AS (SELECT tid, arg_max(item, rank) AS root FROM r GROUP BY 1), dc AS (SELECT root, item, COUNT(*) AS count FROM r JOIN q USING (tid) WHERE item <> root GROUP BY 1, 2), md AS (SELECT LEAST(root, dc.item) AS i, GREATEST(root, dc.item) AS j, CAST((x.miu + y.miu) * count AS BIGINT) AS bound FROM dc JOIN s x ON x.item = dc.item JOIN s y ON y.item = root)"


@query(_sql("order_part", _TU, _STATS, _RANKED, _MD, then="SELECT i, j, MAX(bound) AS bound FROM md GROUP BY 1, 2"))
def md_bounds(spark, d):
    lines = order_part(spark, d)
    found = th.descendant_bounds(st.ranked(lines), st.item_stats(lines))
    return found.select(F.col("itemset")[0].alias("i"), F.col("itemset")[1].alias("j"), "bound").groupBy("i", "j").agg(F.max("bound").alias("bound"))


_LIU = "il AS (SELECT *, rank - ROW_NUMBER() OVER (PARTITION BY tid ORDER BY rank) AS island, SUM(util) OVER (PARTITION BY tid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM r), liu AS (SELECT x.rank AS start, y.rank AS finish, CAST(SUM(y.cum - x.cum + x.util) AS BIGINT) AS utility FROM il x JOIN il y ON x.tid = y.tid AND x.island = y.island AND x.rank < y.rank GROUP BY 1, 2)"
_LB = "rr AS (SELECT rank, CAST(SUM(util) AS BIGINT) AS riu FROM r GROUP BY 1), lb(start, finish, last, n, gone, bound) AS (SELECT start, finish, rank, 1, CAST(rank AS VARCHAR), utility - riu FROM liu JOIN rr ON rank > start AND rank < finish UNION ALL SELECT start, finish, rank, n + 1, gone || ' ' || CAST(rank AS VARCHAR), bound - riu FROM lb JOIN rr ON rank > last AND rank < finish WHERE n < 3)"


@query(_sql("order_ptype", _TU, _STATS, _RANKED, _LIU, then="SELECT start, finish, utility FROM liu"))
def liu_runs(spark, d):
    return st.runs(st.ranked(order_ptype(spark, d))).select(F.col("start").cast("long"), F.col("finish").cast("long"), "utility")


@query(_sql("order_part", _TU, _STATS, _RANKED, _LIU, then="SELECT start, finish, utility FROM liu"))
def liu_runs_order_part(spark, d):
    return st.runs(st.ranked(order_part(spark, d))).select(F.col("start").cast("long"), F.col("finish").cast("long"), "utility")


@query(_sql("nation_brand", _TU, _STATS, _RANKED, _LIU, then="SELECT start, finish, utility FROM liu"))
def liu_runs_long(spark, d):
    return st.runs(st.ranked(nation_brand(spark, d))).select(F.col("start").cast("long"), F.col("finish").cast("long"), "utility")


@query(_sql("cust_ptype", _TU, _STATS, _RANKED, _LIU, _LB, then="SELECT start, finish, gone, CAST(bound AS BIGINT) AS bound FROM lb WHERE bound > 0", recursive=True))
def liu_lb(spark, d):
    rows = st.ranked(cust_ptype(spark, d))
    found = st.run_bounds(st.runs(rows), rows.groupBy("rank").agg(F.sum("util").alias("riu")))
    return found.select(F.col("start").cast("long"), F.col("finish").cast("long"), F.array_join(F.transform("gone", lambda x: x.cast("string")), " ").alias("gone"), "bound")


@query(_sql("order_part", _TU, _STATS, _RANKED, _UL, then="SELECT tid, item, rank, util AS iutil, rutil FROM ul"))
def ul_single(spark, d):
    return st.utility_lists(st.ranked(order_part(spark, d))).select("tid", "item", F.col("rank").cast("long"), F.col("util").alias("iutil"), "rutil")


def _lists(spark, d, n: int) -> tuple[DataFrame, DataFrame]:
    lines = cut(st.utility_lists(st.ranked(order_ptype(spark, d))))
    lists = levelwise.singles(lines)
    for _ in range(n - 1):
        lists = levelwise.extend(lists, lines)
    return lists, lines


def _joined(n: int) -> str:
    names = "xyz"[:n]
    joins = "ul x " + " ".join(f"JOIN ul {b} ON {a}.tid = {b}.tid AND {a}.rank < {b}.rank" for a, b in zip(names, names[1:], strict=False))
    key = " || ' ' || ".join(f"CAST({a}.rank AS VARCHAR)" for a in names)
    return f"u{n} AS (SELECT {key} AS ranks, x.tid AS tid, CAST({' + '.join(f'{a}.util' for a in names)} AS BIGINT) AS iutil, {names[-1]}.rutil AS rutil FROM {joins})"


def _ul_query(n: int):
    @query(_sql("order_ptype", _TU, _STATS, _RANKED, _UL, _joined(n), then=f"SELECT ranks, tid, iutil, rutil FROM u{n}"), f"ul_join_{n}")
    def run(spark, d):
        return _lists(spark, d, n)[0].select(F.concat_ws(" ", F.col("ranks").cast("array<string>")).alias("ranks"), "tid", "iutil", "rutil")


_ul_query(2)
_ul_query(3)


@query(_sql("order_ptype", _TU, _STATS, _RANKED, _UL, _joined(2), then="SELECT ranks, CAST(SUM(iutil) AS BIGINT) AS utility, CAST(SUM(iutil + rutil) AS BIGINT) AS bound, COUNT(*) AS support FROM u2 GROUP BY 1"))
def extension_upper_bound(spark, d):
    return levelwise.measure(_lists(spark, d, 2)[0]).select(F.concat_ws(" ", F.col("ranks").cast("array<string>")).alias("ranks"), "utility", "bound", "support")


def _theta(name: str, basket: str, parts: tuple[str, ...], bounds: str, make, recursive: bool = False):
    sql = _sql(basket, *parts, then=f"SELECT CASE WHEN COUNT(*) >= {K} THEN CAST(MIN(bound) AS BIGINT) ELSE 0 END AS theta FROM (SELECT key, MAX(bound) AS bound FROM ({bounds}) WHERE bound > 0 GROUP BY key ORDER BY bound DESC LIMIT {K})", recursive=recursive)

    @query(sql, name)
    def run(spark, d):
        return th.kth_bound(make(BASKETS[basket](spark, d)), K)


_PAIRS = "pr AS (SELECT x.item AS i, y.item AS j, SUM(x.util + y.util) AS utility FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2)"
_ij = "CAST(i AS VARCHAR) || ' ' || CAST(j AS VARCHAR)"
_theta("theta_riu", "order_part", (_TU, _STATS), "SELECT CAST(item AS VARCHAR) AS key, riu AS bound FROM s", lambda x: th.riu_bounds(st.item_stats(x)))
_theta("theta_pe", "order_part", (_PE,), f"SELECT {_ij} AS key, utility AS bound FROM pe", th.first_pair_bounds)
_theta("theta_cud", "order_part", (_PAIRS,), f"SELECT {_ij} AS key, utility AS bound FROM pr", th.pair_bounds)
_theta("theta_nu", "order_part", (_TU, _STATS, _RANKED, _NU), "SELECT prefix AS key, utility AS bound FROM nu", lambda x: th.node_bounds(st.ranked(x)))
_theta("theta_md", "order_part", (_TU, _STATS, _RANKED, _MD), f"SELECT {_ij} AS key, bound FROM md", lambda x: th.descendant_bounds(st.ranked(x), st.item_stats(x)))
_theta("theta_leaf", "cust_ptype", (_TU, _STATS, _RANKED, _LIU, _LB), "SELECT start || '-' || finish AS key, utility AS bound FROM liu UNION ALL SELECT start || '-' || finish || ' ' || gone, bound FROM lb UNION ALL SELECT CAST(rank AS VARCHAR), riu FROM rr", lambda x: th.leaf_bounds(st.ranked(x)), True)

THETA = 550_000_000


@query(_sql("order_part", _TU, _STATS, then=f"SELECT item, twu FROM s WHERE twu >= {THETA}"))
def promising_items(spark, d):
    return st.item_stats(order_part(spark, d)).filter(F.col("twu") >= THETA).select("item", "twu")


@query(_sql("order_part", _TU, _STATS, then=f"SELECT tid, CAST(SUM(util) AS BIGINT) AS tu FROM b WHERE item IN (SELECT item FROM s WHERE twu >= {THETA}) GROUP BY 1"))
def revised_tx_utility(spark, d):
    return st.ranked(order_part(spark, d), THETA).select("tid", "tu").distinct()


@query(_sql("order_ptype", *_sets_sql("order_ptype"), then="SELECT itemset, utility, support FROM e WHERE length(itemset) - length(replace(itemset, ' ', '')) = 2", recursive=True))
def candidate_verify(spark, d):
    lines = cut(order_ptype(spark, d))
    items = lines.select("item").distinct().agg(F.array_sort(F.collect_list("item")).alias("x"))  # part types: six
    triples = items.select(F.explode(F.expr("flatten(flatten(transform(x, (a, i) -> transform(x, (b, j) -> transform(x, (c, l) -> if(i < j and j < l, array(a, b, c), null))))))")).alias("ranks")).filter("ranks is not null")
    found = two_phase.verify(triples, lines, "item")
    return shown(found.withColumnRenamed("ranks", "itemset"))


_MC = "m(tid, itemset, last, miu) AS (SELECT tid, CAST(item AS VARCHAR), item, miu FROM b JOIN s USING (item) UNION ALL SELECT m.tid, m.itemset || ' ' || CAST(b.item AS VARCHAR), b.item, m.miu + s.miu FROM m JOIN b ON m.tid = b.tid AND b.item > m.last JOIN s ON s.item = b.item), mc AS (SELECT itemset, CAST(SUM(miu) AS BIGINT) AS floor FROM m GROUP BY 1)"


def _floors(spark, d) -> DataFrame:
    rows = cut(st.ranked(order_ptype(spark, d)))
    sets = two_phase.candidates(rows, 1)
    return named(sets.select("ranks", F.col("floor").alias("utility"), F.lit(0).alias("support")), rows.select("rank", "item").distinct())


@query(_sql("order_ptype", _TU, _STATS, _MC, then="SELECT itemset, floor FROM mc", recursive=True))
def mc_bounds(spark, d):
    return _floors(spark, d).select(render(F.col("itemset")).alias("itemset"), F.col("utility").alias("floor"))


@query(_sql("order_ptype", _TU, _STATS, _MC, then=f"SELECT CASE WHEN COUNT(*) >= {K} THEN MIN(floor) ELSE 0 END AS theta FROM (SELECT floor FROM mc WHERE floor > 0 ORDER BY floor DESC LIMIT {K})", recursive=True))
def theta_mc(spark, d):
    return th.kth_bound(_floors(spark, d).select("itemset", F.col("utility").alias("bound")), K)


@query(_sql("order_ptype", *_sets_sql("order_ptype"), then="SELECT itemset, utility, support FROM (SELECT *, RANK() OVER (ORDER BY utility DESC) AS r FROM e) WHERE r <= 7", recursive=True))
def topk_with_ties(spark, d):
    return shown(topk_hui(order_ptype(spark, d), 7, "projected", "all").rows)


@query(_top_sql("order_part", 1000))
def topk_1000_order_part(spark, d):
    return shown(topk_hui(order_part(spark, d), 1000).rows)


@query(_sql("cust_ptype", *_sets_sql("cust_ptype"), then=f"SELECT itemset || ' #UTIL: ' || utility AS line FROM e ORDER BY utility DESC, itemset LIMIT {K}", recursive=True))
def result_lines(spark, d):
    return topk_hui(cust_ptype(spark, d), K).rows.select(result_line(F.col("itemset"), F.col("utility")).alias("line"))


@query(_sql("order_part", then="SELECT tid, string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) || ':' || CAST(CAST(SUM(util) AS BIGINT) AS VARCHAR) || ':' || string_agg(CAST(util AS VARCHAR), ' ' ORDER BY item) AS value FROM b GROUP BY 1"))
def spmf_lines(spark, d):
    return spmf_text(order_part(spark, d))


@query(_sql("order_part", _TU, _STATS, then="SELECT item, twu, riu, miu, mau, support FROM s"))
def spmf_roundtrip(spark, d):
    again = cut(parse_spmf(spmf_text(order_part(spark, d)).select("value"), "failfast"))
    return st.item_stats(lines_of(again)).select("item", "twu", "riu", "miu", "mau", "support")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["topk_projected_cust_ptype"](spark, d)
