"""Exact medians by digits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortscope.operators.selection import exact_median


def test_median_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("a", None, int(x)) for x in rng.integers(0, 2 ** 40, 501)] + [("b", 1, int(x)) for x in rng.integers(0, 300, 400)]
    rows += [(None, 1, 7), (None, 1, 2 ** 40 - 1), ("one", 0, 0), ("none", 0, None), ("ties", 0, 65536), ("ties", 0, 65536), ("ties", 0, 65535), ("ties", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, v long")
    got = {(r.g, r.h): (r.n, r.m) for r in exact_median(df.repartition(5), ["g", "h"], "v", "m").collect()}
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).extend([] if v is None else [v])
    assert got == {k: (len(v), float(np.median(v)) if v else None) for k, v in want.items()}


def test_median_of_no_rows_and_of_values_out_of_range(spark):
    df = spark.createDataFrame([("a", -1)], "g string, v long")
    assert exact_median(df.where("v > 0"), ["g"], "v").count() == 0
    with pytest.raises(Exception, match="not within"):
        exact_median(df, ["g"], "v").collect()


def test_median_keeps_no_group_in_a_buffer(spark):
    plan = exact_median(spark.range(10).select((F.col("id") % 2).alias("g"), "id"), ["g"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "collect_" not in plan


def test_numbers_over_several_ranges(spark):
    from cohortscope.operators.numbering import number_rows
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.when(F.col("id") % 3 == 0, None).otherwise("x").alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.no, r.v) for r in number_rows(df, ["v"], "no").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(k + 1, k) for k in range(500)]
    assert number_rows(df.where("v < 0"), ["v"], "no").count() == 0
