"""Utility transactions as text: `items:utility of the transaction:utilities`, and result lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.itemsets import result_line
from quarry.sources.baskets import checked


def parse_spmf(lines: DataFrame, mode: str = "permissive", trust_tu: bool = False) -> DataFrame:
    """Transactions (tid, items, utils, tu) of the text column `value`.

    Blank lines and those that begin with #, % or @ are no transactions. A line with fewer than three sections, with
    as many items as it has no utilities, or with what is no integer is left out (permissive) or raises (failfast).
    tu is the sum of the utilities unless it is to be trusted. tid tells lines apart and means nothing else; lines of a stream have none.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"mode {mode!r}")

    def numbers(section: int):
        words = F.filter(F.split(F.get("sections", F.lit(section)), r"\s+"), lambda x: x != "")
        return F.transform(words, lambda x: x.try_cast("long"))

    rows = lines.filter(~F.col("value").rlike(r"^\s*([#%@]|$)")).withColumn("sections", F.split("value", ":"))
    rows = rows.select("value", (F.lit(None).cast("long") if lines.isStreaming else F.monotonically_increasing_id()).alias("tid"), numbers(0).alias("items"), F.trim(F.get("sections", F.lit(1))).try_cast("long").alias("said"), numbers(2).alias("utils"))
    whole = F.expr("items is not null and utils is not null and said is not null and size(items) > 0 and size(items) = size(utils) and forall(items, x -> x is not null) and forall(utils, x -> x is not null)")
    whole = F.coalesce(whole, F.lit(False))
    if mode == "failfast":
        rows = rows.withColumn("items", F.when(whole, F.col("items")).otherwise(F.raise_error(F.concat(F.lit("not a transaction: "), F.col("value")))))
    else:
        rows = rows.filter(whole)
    total = F.aggregate("utils", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("tid", "items", "utils", (F.col("said") if trust_tu else total).alias("tu"))


def read_spmf(spark: SparkSession, path: str, mode: str = "permissive", trust_tu: bool = False) -> DataFrame:
    return parse_spmf(spark.read.text(path), mode, trust_tu)


def lines_of(parsed: DataFrame) -> DataFrame:
    """(tid, item, util), items that repeat in a transaction summed."""
    rows = parsed.select("tid", F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("utils").alias("util"))))
    return checked(rows.groupBy("tid", "item").agg(F.sum("util").alias("util")))


def positions_of(parsed: DataFrame) -> DataFrame:
    """(tid, pos, item, util, tu) as written."""
    return parsed.select("tid", "tu", F.posexplode(F.arrays_zip("items", "utils")).alias("pos", "x")).select("tid", "pos", F.col("x.items").alias("item"), F.col("x.utils").alias("util"), "tu")


def metadata(parsed: DataFrame) -> DataFrame:
    """(max_item, transactions)."""
    return parsed.agg(F.max(F.array_max("items")).alias("max_item"), F.count("*").alias("transactions"))


def spmf_text(lines: DataFrame) -> DataFrame:
    """Lines of (tid, item, util) as transactions in text, items in their natural order."""
    rows = lines.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("item", "util"))).alias("x"), F.sum("util").alias("tu"))
    words = lambda field: F.array_join(F.transform("x", lambda x: x[field].cast("string")), " ")
    return rows.select("tid", F.concat_ws(":", words("item"), F.col("tu").cast("string"), words("util")).alias("value"))


def write_spmf(lines: DataFrame, path: str) -> None:
    spmf_text(lines).select("value").write.text(path)


def write_result(result: DataFrame, path: str) -> None:
    """`items #UTIL: utility` in one file, from the largest utility down; a result has k rows, so one task writes it."""
    result.orderBy(F.col("utility").desc(), "itemset").select(result_line(F.col("itemset"), F.col("utility")).alias("value")).coalesce(1).write.text(path)
