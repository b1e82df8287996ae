"""Exact order statistics of whole numbers without a buffer that grows with the data.

``percentile`` and ``median`` keep a value -> count map of a group in one task. Here the
values of all groups are first counted (``(group, value)`` rows, combined
map-side and spread by value), and the wanted ranks are then found digit by
digit, as in a radix sort: the counts of the leading 20 bits say in which range a
rank lies, the next pass looks only into that range. A window runs over at most
2^20 digit counts of one group and rank, whatever the group holds; the counted values are read once and reused by all passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 20


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", count: str = "n", bits: int = 40) -> DataFrame:
    """``(*by, count, out)``: the number of values and their median (the mean of the two middle ones), per group.

    ``value`` holds whole numbers from 0 up to ``2 ** bits`` - 1 (a value outside raises an error); NULL values
    are skipped, a group without any has count 0 and a NULL median. NULL groups are groups.
    """
    v = F.col(value).cast("long")
    checked = F.when(v.isNull() | ((v >= 0) & (v < 2 ** bits)), v).otherwise(F.raise_error(F.lit(f"{value} is not within {bits} bits")).cast("long"))
    every = df.select(F.struct(*[F.col(c) for c in by], F.lit(0)).alias("__g"), F.coalesce(checked, F.lit(-1)).alias("__v")).groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
    at = (every.groupBy("__g").agg(F.coalesce(F.sum(F.when(F.col("__v") >= 0, F.col("__n"))), F.lit(0)).alias("__all"))
          .select("__g", "__all", F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), F.expr(e).alias("__rank")) for k, e in enumerate(("(__all - 1) div 2", "__all div 2"))])).alias("x"))
          .select("__g", "__all", "x.*", F.lit(0).cast("long").alias("__prefix")))
    groups = at.where("__k = 0").select("__g", "__all")
    at = at.drop("__all").where("__rank >= 0")
    for low in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
        digits = (every.withColumn("__prefix", F.shiftright("__v", low + DIGIT)).join(at, ["__g", "__prefix"])
                  .groupBy("__g", "__k", "__rank", F.shiftright("__v", low).alias("__prefix")).agg(F.sum("__n").alias("__n")))
        upto = F.sum("__n").over(Window.partitionBy("__g", "__k").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = (digits.withColumn("__upto", upto).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
              .select("__g", "__k", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"), "__prefix"))
    middle = at.groupBy("__g").agg((F.sum("__prefix") / F.count(F.lit(1))).alias(out))
    return groups.join(middle, "__g", "left").select(*[F.col(f"__g.{c}").alias(c) for c in by], F.col("__all").alias(count), out)
