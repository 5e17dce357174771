"""Running sums over many rows, without a window that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of so many neighbours are summed together before sums run over a group.
STRIDE = 4096


def running(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with `before`, the sum of value over the group's rows of smaller order (a whole number, unique in a group).

    Sums run within blocks of STRIDE numbers, and over the sums of blocks within blocks of blocks, and so on in effect: the
    last window sees a row for each STRIDE * STRIDE numbers of a group.
    """
    small, large = F.floor(F.col(order) / STRIDE), F.floor(F.col(order) / (STRIDE * STRIDE))
    ahead = lambda by, *within: F.coalesce(F.sum(value).over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy(group, small.alias("__small"), large.alias("__large")).agg(F.sum(value).alias(value))
    tops = blocks.groupBy(group, "__large").agg(F.sum(value).alias(value))
    tops = tops.select(group, "__large", ahead("__large", group).alias("__top"))
    blocks = blocks.withColumn("__middle", ahead("__small", group, "__large")).join(tops, [group, "__large"]).select(group, "__small", (F.col("__top") + F.col("__middle")).alias("__ahead"))
    inside = rows.withColumn("__small", small).withColumn("__inside", ahead(order, group, "__small"))
    return inside.join(blocks, [group, "__small"]).select(*rows.columns, (F.col("__ahead") + F.col("__inside")).alias("before"))
