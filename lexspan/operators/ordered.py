"""Numbering rows of a key in order, whatever the key's size.

A window over a key puts all of its rows into one task. Where the order is an integer, the rows of a
key are cut into ranges of it; rows are numbered within a range, and ranges get the counts
before them, which is a window over far fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that share a range.
RANGE = 100_000


def numbered(rows: DataFrame, key: str, order: str, number: str = "rn", total: str = "n", width: int = RANGE) -> DataFrame:
    """``rows`` with their number in order (from 1) and the number of rows of their key; the order is unique in a key."""
    cut = rows.withColumn("__range", F.floor(F.col(order) / width))
    counts = cut.groupBy(key, "__range").agg(F.count("*").alias("__count"))
    w = Window.partitionBy(key)
    before = counts.withColumn("__before", F.coalesce(F.sum("__count").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum("__count").over(w))
    joined = cut.join(before.drop("__count"), [key, "__range"])
    inside = F.row_number().over(Window.partitionBy(key, "__range").orderBy(order))
    return joined.withColumn(number, F.col("__before") + inside).drop("__range", "__before")
