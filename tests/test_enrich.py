"""Column functions on the edge rows listed in FIXTURES.md."""

from pyspark.sql import functions as F

from cohortscope.functions import enrich, json_fields as J


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_geo_and_demographics(spark):
    assert _one(spark, [("US",), ("KZ",), (None,)], "c string", enrich.geo_bucket("c")) == ["T1", "WW", "WW"]
    assert _one(spark, [("",), (None,), ("25-34",)], "c string", enrich.clean_age("c")) == \
        ["other", "other", "25-34"]
    assert _one(spark, [("Mujer",), ("Hombre",), ("female",), ("x",)], "c string",
                enrich.normalize_gender("c")) == ["Female", "Male", "Female", "other"]
    assert _one(spark, [("insta_bio",), ("TikTok",), ("tiktok",), (None,)], "c string",
                enrich.utm_bucket("c")) == ["facebook", "TikTok", "other", "other"]
    assert _one(spark, [("apple_pay",), ("card",)], "c string",
                enrich.normalize_payment_method("c")) == ["applepay", "card"]


def test_user_agent_rules(spark):
    rows = [("Mozilla/5.0 (Windows NT 10.0) Chrome/130.0 Safari/537.36 OPR/115.0",),
            ("Mozilla/5.0 (iPhone; iPhone15,2; CPU iPhone OS like Mac OS X) Safari/604.1",),
            ("Mozilla/5.0 (Linux; Android 15; Pixel 9 Pro) Chrome/130.0",),
            (None,)]
    df = spark.createDataFrame(rows, "ua string").select(
        enrich.browser("ua").alias("b"), enrich.operating_system("ua").alias("os"),
        enrich.device_model("ua").alias("d"), enrich.device_type("ua").alias("t"))
    got = [tuple(r) for r in df.collect()]
    assert got[0][0] == "Other"                      # Opera on Chromium
    assert got[1][1] == "iOS" and got[1][2] == "iPhone14 Pro"
    assert got[2][2] == "Google Pixel 9 Pro"         # rule order
    assert got[3] == ("Other", "Other", "other", "Unknown")


def test_split_from_url(spark):
    rows = [(None, "https://x/?source=register&upsell_version=u15.4.1&z=1"),
            (None, "https://x/?source=register"), ("u15.3.1", "https://x/?upsell_version=zz")]
    got = _one(spark, rows, "m string, r string", enrich.experiment_split("m", "r"))
    assert got == ["u15.4.1", None, "u15.3.1"]


def test_json_scalar_semantics(spark):
    rows = [('{"a": {"b": 1}, "n": 5, "t": true, "s": "x", "z": null}',), (None,), ("not json",)]
    df = J.with_metadata(spark.createDataFrame(rows, "j string"), "j", "m", ["a", "n", "t", "s", "z"])
    got = [tuple(r) for r in df.select("m.*").collect()]
    assert got[0] == (None, "5", "true", "x", None)   # object -> NULL, scalars as text
    assert got[1] == (None,) * 5 and got[2] == (None,) * 5


def test_retention_bucket_boundaries(spark):
    minutes = [-30, 0, 1440, 1441, 2880, 11520, 11521, 44640, 44641, None]
    got = _one(spark, [(m,) for m in minutes], "m long", enrich.retention_bucket("m"))
    assert got == ["Day 0", "Day 0", "Day 0", "Day 1", "Day 1", "Day 7", "Day 30", "Day 30",
                   "> 30", "> 30"]
    daily = _one(spark, [(m,) for m in (1, 1440, 1441, 44640)], "m long",
                 enrich.retention_bucket("m", "daily"))
    assert daily == ["Day 0", "Day 0", "Day 1", "Day 30"]


def test_upsell_order_of(spark):
    assert _one(spark, [(-14,), (-20,), (-22,), (1,)], "r int", enrich.upsell_order_of("r")) == \
        ["1", "2", "2", None]
