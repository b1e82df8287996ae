"""Bitmap prefilter: loses no partner, lets few strangers through, and stands before the parse and the shuffle."""

import math

import __spark_entry__ as E
from conftest import SF_SMALL
from pyspark.sql import functions as F

from cohortscope.operators.prefilter import probable


def test_keeps_every_partner_and_few_strangers(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit("clash").alias("key"), (F.col("id") % 7).alias("n"))
    rows = rows.unionByName(rows.where("n = 0")).unionByName(rows.limit(5).withColumn("user_id", F.lit(None).cast("string")))
    keys = spark.range(3_000).select(F.concat(F.lit("u"), F.col("id") * 5).alias("user_id"))
    keys = keys.unionByName(keys).unionByName(keys.limit(1).select(F.lit(None).cast("string").alias("user_id")))
    for bits in (1 << 15, 1 << 18, 1 << 26):
        kept = probable(rows, keys, "user_id", bits)
        assert kept.columns == rows.columns
        partners = rows.join(keys.distinct(), "user_id", "left_semi")
        assert partners.exceptAll(kept).count() == 0  # with repeats
        assert kept.where("user_id is null").count() == 0
        strangers = kept.join(keys, "user_id", "left_anti")
        share = strangers.count() / rows.join(keys, "user_id", "left_anti").count()
        assert share <= 1.3 * (1 - math.exp(-3_000 / bits)) + 1e-3, (bits, share)
        assert kept.exceptAll(rows).count() == 0  # no row twice
    assert probable(rows, keys.limit(0), "user_id").count() == 0
    assert probable(rows.limit(0), keys, "user_id").count() == 0


def test_stands_before_the_parse_and_the_shuffle(spark):
    plan = E.queries()["upsell_user_level_prefiltered"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    test = next(i for i, x in enumerate(lines) if "BroadcastHashJoin" in x and "getbit" in x)  # the bit is the join's condition
    depth = lambda x: len(x) - len(x.lstrip(" +-:|"))
    above, least = [], depth(lines[test])
    for x in reversed(lines[:test]):  # the operators over the filter
        if depth(x) < least:
            above.append(x)
            least = depth(x)
    first = next(i for i, x in enumerate(above) if "Exchange hashpartitioning" in x)
    assert any("json_tuple" in x for x in above[:first])  # parsed after it, before the first shuffle
    app = lines[test + 1:]
    scan = next(i for i, x in enumerate(app) if "FileScan" in x)
    assert not any("Exchange" in x or "json_tuple" in x for x in app[:scan])  # the log itself goes straight into it
