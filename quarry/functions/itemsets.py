"""Column functions on itemsets and utilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(measure: Column, scale: int = 100) -> Column:
    """A decimal measure as whole units, row by row, so that sums are exact in any order."""
    return F.round(measure * scale).cast("long")


def canonical(items: Column) -> Column:
    return F.array_sort(items)


def render(items: Column) -> Column:
    """The items of an itemset in their natural order, with spaces between."""
    return F.array_join(F.transform(canonical(items), lambda x: x.cast("string")), " ")


def result_line(items: Column, utility: Column) -> Column:
    return F.concat(render(items), F.lit(" #UTIL: "), utility.cast("string"))
