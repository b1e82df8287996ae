"""As-of operator against brute force; retention buckets on hand-made timestamps."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cohortscope.operators.asof import asof
from cohortscope.operators.retention import bucket_presence

T0 = dt.datetime(2024, 1, 1)


def _brute(probes, events, direction):
    out = {}
    for pid, key, t in probes:
        cands = [e for k, e in events if k == key and (e >= t if direction == "forward" else e <= t)]
        out[pid] = (min(cands) if direction == "forward" else max(cands)) if cands else None
    return out


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    keys = ["a", "b", "c", None]
    events = [(rnd.choice(keys), T0 + dt.timedelta(minutes=rnd.randint(0, 3000))) for _ in range(300)]
    probes = [(i, rnd.choice(keys), T0 + dt.timedelta(minutes=rnd.randint(-100, 3100))) for i in range(200)]
    # exact ties with events
    probes += [(1000 + i, k, t) for i, (k, t) in enumerate(events[:20])]
    p = spark.createDataFrame(probes, "pid long, k string, t timestamp_ntz")
    e = spark.createDataFrame(events, "k string, ts timestamp_ntz")
    for direction in ("forward", "backward"):
        # 10-minute blocks: most lookups cross blocks
        got = {r.pid: r.nxt for r in asof(p, e, ["k"], "t", "ts", "nxt", direction, 600).collect()}
        want = _brute(probes, [(k, t) for k, t in events if k is not None], direction)
        assert got == want, direction


def test_bucket_presence_boundaries(spark):
    p = dt.datetime(2024, 1, 10, 12, 0, 30)
    offsets = {  # seconds after purchase -> expected bucket
        "Day 0": [1440 * 60 + 59, -3600],   # 1440 min 59 s is still Day 0; before purchase too
        "Day 1": [1441 * 60],
        "Day 7": [11520 * 60],
        "Day 30": [11521 * 60, 44640 * 60],
        "> 30": [44641 * 60],
    }
    events = [("u1", p + dt.timedelta(seconds=s)) for v in offsets.values() for s in v]
    entries = spark.createDataFrame([("u1", p), ("u2", p)], "user_id string, purch_timestamp timestamp_ntz")
    ev = spark.createDataFrame(events, "user_id string, timestamp timestamp_ntz")
    got = {r.bucket for r in bucket_presence(entries, ev).where(F.col("user_id") == "u1").collect()}
    assert got == set(offsets)
    assert bucket_presence(entries, ev).where(F.col("user_id") == "u2").count() == 0


def test_bucket_presence_matches_pairwise(spark):
    rnd = random.Random(3)
    from cohortscope.functions.enrich import retention_bucket
    ents = [(f"u{rnd.randint(0, 4)}", T0 + dt.timedelta(minutes=rnd.randint(0, 20000),
                                                         seconds=rnd.randint(0, 59))) for _ in range(40)]
    evs = [(f"u{rnd.randint(0, 4)}", T0 + dt.timedelta(minutes=rnd.randint(-3000, 70000),
                                                        seconds=rnd.randint(0, 59))) for _ in range(400)]
    entries = spark.createDataFrame(ents, "user_id string, purch_timestamp timestamp_ntz").distinct()
    ev = spark.createDataFrame(evs, "user_id string, timestamp timestamp_ntz")
    for mode in ("reference", "daily"):
        got = {tuple(r) for r in bucket_presence(entries, ev, mode).collect()}
        pairs = (entries.join(ev, "user_id")
                 .select("user_id", "purch_timestamp", retention_bucket(
                     F.timestamp_diff("MINUTE", F.col("purch_timestamp"), F.col("timestamp")), mode)
                     .alias("bucket")).distinct())
        assert got == {tuple(r) for r in pairs.collect()}, mode


def test_one_hot_hour_is_spread_over_its_sub_blocks(spark):
    """Most rows of one key lie in one hour, many at the same times: right, and no window group larger than a sub-block."""
    rnd = random.Random(11)
    at = lambda: T0 + dt.timedelta(seconds=rnd.randint(0, 3599), milliseconds=rnd.choice([0, 0, 250]))
    events = [("hot", at()) for _ in range(900)] + [("hot", T0 + dt.timedelta(hours=h)) for h in (-30, 50)] + [("cold", at())]
    probes = [(i, "hot", at()) for i in range(1500)] + [(2000 + i, rnd.choice(["hot", "cold", "none"]), T0 + dt.timedelta(minutes=rnd.randint(-2000, 4000))) for i in range(100)]
    p = spark.createDataFrame(probes, "pid long, k string, t timestamp_ntz")
    e = spark.createDataFrame(events, "k string, ts timestamp_ntz")
    probes += [(3000, "hot", None), (3001, None, T0)]
    p = spark.createDataFrame(probes, "pid long, k string, t timestamp_ntz")
    for direction in ("forward", "backward"):
        for sub in (15, 1, 3600):
            got = {r.pid: r.nxt for r in asof(p, e, ["k"], "t", "ts", "nxt", direction, 3600, sub).collect()}
            assert got.pop(3000) is None and got.pop(3001) is None  # no time, no key
            assert got == _brute(probes[:-2], events, direction), (direction, sub)
    plan = asof(p, e, ["k"], "t", "ts", "nxt")._jdf.queryExecution().executedPlan().toString()
    assert "__s" in plan.split("windowspecdefinition(k")[1].split(")")[0]


def _event_scans(df):
    """Scans of event tables in the plan that ran (reused exchanges count once)."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("event_name" in part.split("ReadSchema")[0] for part in final.split("FileScan parquet")[1:]), final


def test_matrices_read_cohort_and_activity_once(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    for name in ("retention_matrix", "retention_matrix_geo", "retention_daily"):
        scans, plan = _event_scans(E.queries()[name](spark, SF_SMALL))
        assert scans <= 3, (name, scans)
        assert "ReusedExchange" in plan


def test_masks_hold_every_slice(spark):
    """Slices and the total are aggregates of masks; a user with two entries on a day counts once."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    total = {(r.cohort_date): r.cohort_users for r in E.queries()["retention_matrix"](spark, SF_SMALL).collect()}
    slices = {}
    for r in E.queries()["retention_matrix_geo"](spark, SF_SMALL).collect():
        slices[r.cohort_date] = slices.get(r.cohort_date, 0) + r.cohort_users
    assert total.keys() == slices.keys() and all(slices[d] >= n for d, n in total.items())
