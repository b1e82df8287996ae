"""Readers and sinks: partition pruning, fixed-schema CSV, extract and report writers."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from cohortscope.operators import volume as V
from cohortscope.sources import driver_tables, events as S, sinks
from conftest import SF_SMALL


def _scratch():
    return tempfile.mkdtemp(prefix="cohortscope-io-")


def test_read_events_prunes_partitions(spark):
    d = os.path.join(_scratch(), "funnel")
    driver_tables.derive(spark, SF_SMALL).funnel.write.partitionBy("event_date").parquet(d)
    df = S.read_events(spark, d, start=dt.date(2024, 1, 10), end=dt.date(2024, 1, 12))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    days = {r[0] for r in df.select("event_date").distinct().collect()}
    assert days and days <= {dt.date(2024, 1, d) for d in (10, 11, 12)}
    # columns absent from the stored table come back as NULL under the fixed schema
    assert df.select(F.count("user_metadata")).first()[0] == 0


def test_read_payments_converts_micros(spark):
    d = os.path.join(_scratch(), "payments")
    driver_tables.derive(spark, SF_SMALL).payments.write.parquet(d)
    p = S.read_payments(spark, d)
    r = p.select(F.min("created_ts"), F.min("created_at")).first()
    assert r[0] == dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r[1])


def test_read_upsell_csv_fixed_schema(spark):
    d = _scratch()
    path = os.path.join(d, "pull.csv")
    cols = [f.name for f in S.UPSELL_PULL_SCHEMA.fields]
    with open(path, "w") as fh:
        fh.write(",".join(cols) + "\n")
        vals = {"timestamp": "2024-01-10 10:00:00", "split": "u15.3.1", "upsell_order": "1",
                "user_id": "7", "ups_view": "1", "ups_ttp": "0", "ups_purched": "0",
                "purch_amount": "12.5", "ticket_count": ""}
        fh.write(",".join(vals.get(c, "") for c in cols) + "\n")
    df = S.read_upsell_csv(spark, path)
    assert df.schema == S.UPSELL_PULL_SCHEMA
    r = df.first()
    assert r.purch_amount == 12.5 and r.ticket_count is None and r.ups_view == 1


def test_write_extract_replaces_only_present_partitions(spark):
    out = os.path.join(_scratch(), "extract")
    funnel = driver_tables.derive(spark, SF_SMALL).funnel
    daily = V.daily_volume(funnel, dt.datetime(2024, 1, 31), days=30)
    sinks.write_extract(daily, out, "event_date")
    before = sinks.read_extract(spark, out).count()
    one_day = daily.orderBy("event_date").limit(1).withColumn("subscribes", F.lit(-1).cast("long"))
    sinks.write_extract(one_day, out, "event_date")
    after = sinks.read_extract(spark, out)
    assert after.count() == before
    assert after.where(F.col("subscribes") == -1).count() == 1


def test_write_report_orders_lines(spark):
    out = os.path.join(_scratch(), "report")
    lines = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "line_no long, line string")
    sinks.write_report(lines, out)
    text = [r[0] for r in spark.read.text(out).collect()]
    assert text == ["a", "b", "c"]


def test_extract_runs_once_and_survives_a_killed_refresh(spark):
    out = os.path.join(_scratch(), "extract")
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            runs.add(len(f))
            yield f
    day = lambda n, v: spark.range(n).select(F.lit(v).cast("date").alias("event_date"), "id")
    days = day(3, "2024-01-01").unionByName(day(2, "2024-01-02")).mapInPandas(counted, "event_date date, id long")
    sinks.write_extract(days, out, "event_date")
    assert runs.value == 5  # the result is not computed again to see which days it has
    seen = sinks.read_extract(spark, out)
    try:
        sinks.write_extract(day(9, "2024-01-02").withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long")), out, "event_date")
        raise AssertionError("the refresh should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert sorted(r.id for r in sinks.read_extract(spark, out).collect()) == [0, 0, 1, 1, 2]
    # a refresh without rows for one of its days drops that day; who read before still can
    sinks.write_extract(day(1, "2024-01-03"), out, "event_date", refreshed=[dt.date(2024, 1, 2), dt.date(2024, 1, 3)])
    got = sinks.read_extract(spark, out)
    assert sorted((str(r.event_date), r.id) for r in got.collect()) == [("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-03", 0)]
    assert seen.count() == 5 and got.schema["event_date"].dataType.simpleString() == "date"
    # versions that no manifest names any more go
    for k in range(3):
        sinks.write_extract(day(k + 1, "2024-01-03"), out, "event_date")
    assert len([n for n in os.listdir(out) if n.startswith("version-")]) <= 3


def test_extract_without_partitions_and_without_rows(spark):
    out = os.path.join(_scratch(), "extract")
    sinks.write_extract(spark.range(3), out)
    sinks.write_extract(spark.range(5), out)
    assert sinks.read_extract(spark, out).count() == 5
    empty = os.path.join(_scratch(), "extract")
    sinks.write_extract(spark.range(0).withColumn("d", F.lit(1)), empty, "d")
    assert sinks.read_extract(spark, empty).count() == 0
