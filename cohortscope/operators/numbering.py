"""Consecutive numbers in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscope.sources.sinks import written

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out`` = 1, 2, ... in ``order`` (ties are numbered in any order).

    The rows are range-partitioned, sorted and written once with their place in
    their partition; each partition's first number is the count of all partitions before it
    (a window over one row per partition).
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _ROW_BITS).alias("__part")
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    at = placed.withColumn("__part", part).join(starts, "__part")
    return at.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("__part", "__before", "__at")
