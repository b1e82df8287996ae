"""A/B analysis: user-level table, metric samples, point estimates by segment.

The notebook loops over 1 + sum(|axis|) segments and runs each metric on
pandas arrays. Here every user-level row is exploded once into
``(axis, segment)`` pairs (``overall`` included) and into ``(metric, value)``
pairs of the metrics whose population it belongs to, and a single
aggregation computes every (segment, metric, arm) statistic. All steps are
map-side combinable aggregations; no segment is collected anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions.stats import exact_avg, exact_sum

SEGMENT_DIMS = ("subscription", "channel", "geo", "payment_method", "utm_source")


def to_user_level(pull: DataFrame, dedupe_cash: bool = False) -> DataFrame:
    """Pull rows -> one row per ``(user_id, split, upsell_order)``.

    Rows with a NULL key are dropped (pandas group keys). Dimensions take the
    first non-NULL value, deterministically the one of the earliest pull row
    (ties by value); flags take the max; ``purch_amount`` sums with all-NULL
    giving 0; ``ticket_count`` is NULL-filled with 0 before summing, and
    ``is_ticket`` is recomputed from it. ``purch_count`` is the user's total
    of ``ups_purched`` over all pull rows. ``ltv`` is averaged when present.

    A slot's views, clicks and unsubscribes repeat its cash in the pull, and the sum
    counts each repetition, as the analysts' does. ``dedupe_cash`` counts each
    distinct (purchases, amount) of a user's slot once.
    """
    df = pull.withColumn("ticket_count", F.coalesce(F.col("ticket_count"), F.lit(0)))
    df = df.withColumn("is_ticket", F.when(F.col("ticket_count") != 0, 1).otherwise(0))
    has_ltv = "ltv" in df.columns
    if has_ltv:
        df = df.withColumn("ltv", F.coalesce(F.col("ltv"), F.lit(0.0)))

    def first(c: str) -> Column:
        present = F.col(c).isNotNull()
        return F.min_by(F.col(c), F.when(present, F.struct(F.col("timestamp"), F.col(c)))).alias(c)

    keys = ("user_id", "split", "upsell_order")
    cash = F.sum("purch_amount")
    if dedupe_cash:  # the distinct prices of one slot of one user
        cash = F.aggregate(F.array_sort(F.collect_set(F.when(F.col("purch_amount").isNotNull(), F.struct("purch_count", "purch_amount")))),
                           F.lit(0.0), lambda total, x: total + x["purch_amount"])
    aggs = [first(c) for c in SEGMENT_DIMS] + [
        F.max("ups_view").alias("ups_view"), F.max("ups_ttp").alias("ups_ttp"),
        F.max("ups_purched").alias("ups_purched"), F.max("unsub12h").alias("unsub12h"),
        # rounded: the sum of doubles must not depend on the summation order
        F.round(F.coalesce(cash, F.lit(0.0)), 6).alias("purch_amount"),
        F.sum("ticket_count").alias("ticket_count"), F.max("is_ticket").alias("is_ticket"),
    ] + ([F.round(F.avg("ltv"), 6).alias("ltv")] if has_ltv else [])
    # one aggregation over the pull: groups with a NULL split or slot are kept
    # until the user's purchase total (over all of the user's rows) is taken,
    # as a window over the aggregated rows -- a few rows per user
    per_key = (df.where(F.col("user_id").isNotNull()).groupBy(*keys)
               .agg(*aggs, F.sum("ups_purched").alias("__purch")))
    per_key = per_key.withColumn("purch_count", F.sum("__purch").over(Window.partitionBy("user_id")))
    not_null = F.col(keys[1]).isNotNull() & F.col(keys[2]).isNotNull()
    return per_key.where(not_null).drop("__purch")


@dataclass(frozen=True)
class Metric:
    metric_id: int
    name: str
    statistic: str            # 'mean' or 'sum'
    population: Column | None  # None = all rows
    value: Column
    needs: str | None = None  # optional input column


def _c(name: str) -> Column:
    return F.col(name)


def metric_definitions(columns, documented: bool = False) -> list[Metric]:
    """The twelve comparison metrics, in report order (LTV only with an ``ltv`` column).

    ``documented`` adds the AOV as its written definition has it: over purchasers with a settled
    payment, without those whose amounts are all unknown (whom the plain AOV counts with 0).
    """
    v, t, p = (_c("ups_view") == 1), (_c("ups_ttp") == 1), (_c("ups_purched") == 1)
    out = [
        Metric(1, "Upsell View Count", "sum", None, _c("ups_view")),
        Metric(2, "Upsell TTP Rate (on View)", "mean", v, _c("ups_ttp")),
        Metric(3, "Upsell SR (on TTP)", "mean", t, _c("ups_purched")),
        Metric(4, "Upsell Rate (on View)", "mean", v, _c("ups_purched")),
        Metric(5, "Upsell Gain (on View)", "mean", v, _c("purch_amount")),
        Metric(6, "LTV", "mean", v, _c("ltv") if "ltv" in columns else F.lit(None), needs="ltv"),
        Metric(7, "Unsub 12h Rate (on View)", "mean", v, _c("unsub12h")),
        Metric(8, "Unsub 12h Rate (on Upsell Purchase)", "mean", p, _c("unsub12h")),
        Metric(9, "Ticket Users Share (on All Users)", "mean", None,
               F.when(p & (_c("ticket_count") != 0), 1).otherwise(0)),
        Metric(10, "Ticket Users Share (on Purch Users)", "mean", v & (_c("ups_purched") != 0),
               _c("is_ticket")),
        Metric(11, "AOV (on Purch Users)", "mean", p, _c("purch_amount")),
    ]
    if documented:
        out.append(Metric(13, "AOV (on Settled Purch Users)", "mean", p & (_c("purch_amount") > 0), _c("purch_amount")))
    return [m for m in out if m.needs is None or m.needs in columns]


PER_USER_METRIC = (12, "Avg Purchases per User", "mean")


def with_segments(user_df: DataFrame, axes=config.SEGMENT_AXES) -> DataFrame:
    """One row per (user row, segment): ``overall`` plus one per axis with a value."""
    segs = [F.struct(F.lit("overall").alias("axis"), F.lit("overall").alias("segment"))]
    segs += [F.struct(F.lit(name).alias("axis"), F.col(col).cast("string").alias("segment"))
             for name, col in axes]
    return (user_df.withColumn("__seg", F.explode(F.array(*segs)))
            .where(F.col("__seg.segment").isNotNull())
            .select("*", "__seg.axis", "__seg.segment").drop("__seg"))


def metric_samples(seg_df: DataFrame, documented: bool = False) -> DataFrame:
    """Long samples ``(axis, segment, split, metric_id, metric, statistic, value)``.

    A row contributes to a metric only inside the metric's population (the
    notebook's mask + dropna). The per-user metric regroups each arm's rows
    by user first.
    """
    metrics = metric_definitions(seg_df.columns, documented)
    items = []
    for m in metrics:
        keep = m.value.isNotNull() if m.population is None else (m.population & m.value.isNotNull())
        items.append(F.when(keep, F.struct(F.lit(m.metric_id).alias("metric_id"),
                                           F.lit(m.name).alias("metric"),
                                           F.lit(m.statistic).alias("statistic"),
                                           m.value.cast("double").alias("value"))))
    rows = (seg_df.select("axis", "segment", "split",
                          F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("__m"))
            .select("axis", "segment", "split", "__m.*"))
    mid, name, stat = PER_USER_METRIC
    per_user = (seg_df.groupBy("axis", "segment", "split", "user_id")
                .agg(F.sum("ups_purched").cast("double").alias("value"))
                .select("axis", "segment", "split", F.lit(mid).alias("metric_id"),
                        F.lit(name).alias("metric"), F.lit(stat).alias("statistic"), "value"))
    return rows.unionByName(per_user)


def arm_order(split: str = "split", control: str | None = None) -> Column:
    """Sort key of the arms: the named control first, else by name (NULL for a NULL arm)."""
    c = F.col(split)
    other = F.lit(True) if control is None else c != control
    return F.when(c.isNotNull(), F.struct(other.alias("other"), c.alias("arm")))


def has_control(clean: str, control: str | None) -> Column:
    return F.lit(True) if control is None else F.col(clean) == control


def segment_arms(seg_df: DataFrame, min_rows: int = config.MIN_SEGMENT_ROWS,
                 control: str | None = None) -> DataFrame:
    """Per segment: row count, arm count, control and test arm, and whether it is analysed
    (two arms, and >= ``min_rows`` rows except overall). The control is ``control``, without
    which a segment is not analysed, or else the smallest split name."""
    s = seg_df.groupBy("axis", "segment").agg(
        F.count(F.lit(1)).alias("segment_rows"),
        F.count_distinct("split").alias("n_arms"),
        F.min(arm_order("split", control))["arm"].alias("clean_split"),
        F.max(arm_order("split", control))["arm"].alias("test_split"))
    ok = (F.col("n_arms") == 2) & ((F.col("axis") == "overall") | (F.col("segment_rows") >= min_rows))
    return s.withColumn("analysed", ok & has_control("clean_split", control))


def point_estimates(samples: DataFrame, arms: DataFrame) -> DataFrame:
    """Control/test statistic, difference, relative difference (%), sizes."""
    stat = (samples.groupBy("axis", "segment", "metric_id", "metric", "statistic", "split")
            .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("value")).alias("s"),
                 exact_avg(F.col("value")).alias("a"))
            .withColumn("stat", F.when(F.col("statistic") == "sum", F.col("s")).otherwise(F.col("a"))))
    j = stat.join(arms.where("analysed"), ["axis", "segment"], "inner")
    is_c, is_t = F.col("split") == F.col("clean_split"), F.col("split") == F.col("test_split")
    wide = (j.groupBy("axis", "segment", "metric_id", "metric", "statistic",
                      "clean_split", "test_split")
            .agg(F.max(F.when(is_c, F.col("stat"))).alias("clean_value"),
                 F.max(F.when(is_t, F.col("stat"))).alias("test_value"),
                 F.max(F.when(is_c, F.col("n"))).alias("clean_n"),
                 F.max(F.when(is_t, F.col("n"))).alias("test_n"))
            .where(F.col("clean_n").isNotNull() & F.col("test_n").isNotNull()))
    diff = F.col("test_value") - F.col("clean_value")
    rel = F.when(F.col("clean_value") != 0, diff / F.col("clean_value") * 100)
    return wide.select(
        "axis", "segment", "metric_id", "metric", "statistic", "clean_split", "test_split",
        F.round("clean_value", 6).alias("clean_value"), F.round("test_value", 6).alias("test_value"),
        F.round(diff, 6).alias("observed_difference"), F.round(rel, 6).alias("relative_difference_pct"),
        "clean_n", "test_n")


def segment_point_estimates(user_df: DataFrame, axes=config.SEGMENT_AXES,
                            min_rows: int = config.MIN_SEGMENT_ROWS,
                            control: str | None = None, documented: bool = False) -> DataFrame:
    seg = with_segments(user_df, axes)
    return point_estimates(metric_samples(seg, documented), segment_arms(seg, min_rows, control))


def metric_point_estimates(user_df: DataFrame, control: str | None = None, documented: bool = False) -> DataFrame:
    """The overall comparison only."""
    return segment_point_estimates(user_df, axes=(), control=control, documented=documented)


def to_long(estimates: DataFrame, experiment: str | None = None) -> DataFrame:
    """Long experiment-metric table: one row per (segment, metric, variant)."""
    name = (F.lit(experiment) if experiment is not None
            else F.concat_ws("_vs_", F.col("clean_split"), F.col("test_split")))
    arms = F.array(
        F.struct(F.col("clean_split").alias("variant"), F.col("clean_value").alias("value"),
                 F.col("clean_n").alias("n")),
        F.struct(F.col("test_split").alias("variant"), F.col("test_value").alias("value"),
                 F.col("test_n").alias("n")))
    return (estimates.select(name.alias("experiment"), "axis", "segment", "metric",
                             F.explode(arms).alias("a"))
            .select("experiment", "axis", "segment", "a.variant", "metric", "a.value", "a.n"))
