"""Summary report of the segment analysis as ``(line_no, line)`` rows.

For each analysed segment (overall first, then the axes in order, values
sorted): if any metric is significant, every metric of the segment is
listed with direction (flipped for metrics where an increase is bad),
values, changes, p-value and decision; otherwise one "no significant
differences" line. Lines are built with native string functions; segments are
numbered over ranges (there may be any number of UTM sources), and the text
sink writes the lines in ``line_no`` order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.operators.numbering import number_rows

# The wording and rules of the report that readers know.
RULE = "=" * 80
DASH = "-" * 80
# metrics whose values and differences are shown with 0 / 2 decimals (others: 4)
ZERO_DECIMALS = ("Upsell View Count",)
TWO_DECIMALS = ("Upsell Gain (on View)", "LTV", "AOV (on Purch Users)")


def _fmt(col: str) -> Column:
    m = F.col("metric")
    return (F.when(m.isin(*ZERO_DECIMALS), F.format_string("%.0f", F.col(col)))
            .when(m.isin(*TWO_DECIMALS), F.format_string("%.2f", F.col(col)))
            .otherwise(F.format_string("%.4f", F.col(col))))


def segment_name(axis: Column, segment: Column) -> Column:
    return F.upper(F.when(axis == "overall", F.lit("overall"))
                   .otherwise(F.concat_ws("_", axis, segment)))


def summary_lines(results: DataFrame) -> DataFrame:
    axis_order = F.coalesce(*[F.when(F.col("axis") == a, F.lit(i + 1))
                              for i, (a, _) in enumerate(config.SEGMENT_AXES)], F.lit(0))
    seg = results.withColumn("axis_order", axis_order)
    per_seg = (seg.groupBy("axis", "segment", "axis_order")
               .agg(F.sum(F.col("significant").cast("int")).alias("n_sig")))
    per_seg = number_rows(per_seg, ["axis_order", "segment"], "seg_no")
    flipped = F.col("metric").isin(*config.NEGATIVE_METRICS)
    direction = F.upper(F.when(flipped & (F.col("direction") == "positive"), F.lit("negative"))
                        .when(flipped & (F.col("direction") == "negative"), F.lit("positive"))
                        .otherwise(F.col("direction")))
    rel = F.when(F.col("relative_difference_pct").isNull(), F.lit("N/A")) \
        .otherwise(F.format_string("%.2f", F.col("relative_difference_pct")))
    sig = F.when(F.col("significant"), F.lit("YES")).otherwise(F.lit("NO"))
    detail = (seg.join(per_seg.where(F.col("n_sig") > 0), ["axis", "segment", "axis_order"])
              .select("seg_no", "metric_id", F.array(
                  F.format_string("  • %s: %s difference", F.col("metric"), direction),
                  F.format_string("    clean: %s, test: %s", _fmt("clean_value"), _fmt("test_value")),
                  F.format_string("    Abs change: %s", _fmt("observed_difference")),
                  F.format_string("    Relative change: %s%%", rel),
                  F.format_string("    p-value: %s", F.format_string("%.4f", F.col("p_value"))),
                  F.format_string("    Significant: %s", sig),
                  F.lit("")).alias("lines"))
              .select("seg_no", "metric_id", F.posexplode("lines").alias("k", "line"))
              .select((F.col("seg_no") * 10000 + 100 + F.col("metric_id") * 10 + F.col("k"))
                      .alias("line_no"), "line"))
    name = segment_name(F.col("axis"), F.col("segment"))
    heads = (per_seg.select("seg_no", F.array(
        F.lit(""), name, F.lit(DASH),
        F.when(F.col("n_sig") > 0,
               F.format_string("Found %d significant differences:", F.col("n_sig")))
        .otherwise(F.lit("No significant differences found.")),
        F.lit("")).alias("lines"))
        .select("seg_no", F.posexplode("lines").alias("k", "line"))
        .select((F.col("seg_no") * 10000 + F.col("k")).alias("line_no"), "line"))
    title = results.sparkSession.createDataFrame(
        [(0, RULE), (1, "UPSELL A/B TEST ANALYSIS SUMMARY REPORT"), (2, RULE), (3, "")],
        "line_no long, line string")
    return title.unionByName(heads.withColumn("line_no", F.col("line_no").cast("long"))) \
        .unionByName(detail.withColumn("line_no", F.col("line_no").cast("long")))
