"""Bootstrap and sensitivity: closed forms, degenerate inputs, determinism."""

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from cohortscope.operators import bootstrap as B
from cohortscope.operators import experiment as X
from cohortscope.operators import sensitivity as SN

N = NormalDist()


def _power_binary(p1, n, d, alpha=0.05):
    p2 = p1 + d
    se = math.sqrt(p1 * (1 - p1) / n + p2 * (1 - p2) / n)
    return 1 - N.cdf(N.inv_cdf(1 - alpha) - d / se)


def _bisect(f, lo, hi):
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def test_closed_form_binary_mde_equals_root_finding(spark):
    rows = []
    for p in (0.05, 0.2, 0.5, 0.8):
        for n in (30, 100, 1000):
            rows.append((0, "m", "binary", "greater", n, n, p, None, 2, "ok"))
    base = spark.createDataFrame(rows, "metric_order int, metric string, type string, alternative string, "
                                       "n_per_group long, n_test long, baseline double, baseline_std double, "
                                       "n_arms long, status string")
    got = {(r.n_per_group, r.baseline): (r.mde_abs, r.status) for r in SN.mde_table(base).collect()}
    for (n, p), (mde, status) in got.items():
        reachable = _power_binary(p, n, 1 - p) >= 0.8
        assert (status == "ok") == reachable
        if reachable:
            want = _bisect(lambda d: _power_binary(p, n, d) - 0.8, 0.0, 1 - p)
            assert abs(mde - want) < 1e-6, (n, p)


def test_continuous_mde_feeds_back_to_target_power(spark):
    base = spark.createDataFrame([(0, "m", "continuous", "greater", 200, 200, 10.0, 4.0, 2, "ok")],
                                 "metric_order int, metric string, type string, alternative string, "
                                 "n_per_group long, n_test long, baseline double, baseline_std double, "
                                 "n_arms long, status string")
    mde = SN.mde_table(base).first().mde_abs
    z_obs = mde / (4.0 * math.sqrt(2 / 200))
    assert abs((1 - N.cdf(N.inv_cdf(0.95) - z_obs)) - 0.8) < 1e-5


def _user_df(spark, rows):
    return spark.createDataFrame(rows, "user_id string, split string, upsell_order string, subscription string, "
                                       "channel string, geo string, payment_method string, utm_source string, "
                                       "ups_view int, ups_ttp int, ups_purched int, unsub12h int, "
                                       "purch_amount double, ticket_count long, is_ticket int, purch_count long")


def _rows(seed=1, n=120):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        arm = "A" if i % 2 else "B"
        buy = int(rnd.random() < (0.3 if arm == "A" else 0.6))
        out.append((f"u{i}", arm, "1", "1Week", "primer", rnd.choice(["T1", "WW"]), "card", "google",
                    1, int(buy or rnd.random() < 0.5), buy, 0, 19.99 * buy, 0, 0, buy))
    return out


def test_bootstrap_is_deterministic_and_partition_independent(spark):
    ud = _user_df(spark, _rows())
    a = {(r.axis, r.segment, r.metric_id): (r.ci_lower, r.ci_upper, r.p_value)
         for r in B.bootstrap_segments(ud, n_boot=2000).collect()}
    b = {(r.axis, r.segment, r.metric_id): (r.ci_lower, r.ci_upper, r.p_value)
         for r in B.bootstrap_segments(ud.repartition(7), n_boot=2000).collect()}
    assert a == b and len(a) > 0


def test_bootstrap_detects_large_difference_and_constant_metric(spark):
    res = {(r.axis, r.metric): r for r in B.bootstrap_segments(_user_df(spark, _rows(n=400)), n_boot=2000,
                                                               axes=()).collect()}
    rate = res[("overall", "Upsell Rate (on View)")]
    assert rate.significant and rate.direction == "positive" and rate.p_value < 0.01
    # every row has ups_view = 1: the resampled sum is constant
    views = res[("overall", "Upsell View Count")]
    assert views.ci_lower == views.ci_upper == views.observed_difference


def test_bootstrap_interval_close_to_normal_theory(spark):
    rows = _rows(seed=5, n=2000)
    res = {r.metric: r for r in B.bootstrap_segments(_user_df(spark, rows), n_boot=4000, axes=()).collect()}
    r = res["Upsell Rate (on View)"]
    pa, pb = r.clean_value, r.test_value
    se = math.sqrt(pa * (1 - pa) / r.clean_n + pb * (1 - pb) / r.test_n)
    assert abs((r.ci_upper - r.ci_lower) - 2 * 1.6449 * se) < 0.15 * 2 * 1.6449 * se


def test_bootstrap_does_not_depend_on_where_it_is_cut(spark):
    import numpy as np
    rnd = np.random.default_rng(6)
    rows = [("g", "ctl", float(x)) for x in rnd.normal(20, 8, 700)] + [("g", "trt", float(x)) for x in rnd.normal(22, 8, 600)]
    rows += [(None, "ctl", -1.5), (None, "ctl", 0.0), (None, "trt", 4.0), (None, "trt", 4.5)]
    df = spark.createDataFrame(rows, "grp string, arm string, v double")
    for statistic in ("mean", "median", "sum", "count"):
        whole, cut = (sorted((str(r.grp), *r[1:]) for r in B.bootstrap_diff(
            df.repartition(parts), by=("grp",), value="v", split="arm", statistic=statistic, n_boot=400, max_task_values=most).collect())
            for parts, most in ((3, 10_000), (9, 25)))
        assert whole == cut and len(whole) == 2  # the NULL group is a group
        if statistic != "count":
            a, b = (np.array([x[2] for x in rows if x[0] and x[1] == arm]) for arm in ("ctl", "trt"))
            fn = {"mean": np.mean, "median": np.median, "sum": np.sum}[statistic]
            ref = [fn(rnd.choice(b, b.size)) - fn(rnd.choice(a, a.size)) for _ in range(4000)]
            got = next(r for r in B.bootstrap_diff(df, by=("grp",), value="v", split="arm", statistic=statistic, n_boot=4000, max_task_values=50).collect() if r.grp)
            width = np.percentile(ref, 95) - np.percentile(ref, 5)
            assert abs(got.ci_lower - np.percentile(ref, 5)) < 0.1 * width and abs(got.ci_upper - np.percentile(ref, 95)) < 0.1 * width


def test_segments_skip_small_and_one_arm(spark):
    rows = _rows(n=60)
    rows += [(f"x{i}", "A", "1", "4Week", "primer", "T1", "card", "google", 1, 0, 0, 0, 0.0, 0, 0, 0)
             for i in range(25)]     # one arm only
    rows += [(f"y{i}", "A" if i % 2 else "B", "1", "12Week", "primer", "T1", "card", "google",
              1, 0, 0, 0, 0.0, 0, 0, 0) for i in range(19)]   # 19 rows
    seg = X.with_segments(_user_df(spark, rows))
    arms = {(r.axis, r.segment): r.analysed for r in X.segment_arms(seg).collect()}
    assert arms[("Subscription", "1Week")] and not arms[("Subscription", "4Week")]
    assert not arms[("Subscription", "12Week")] and arms[("overall", "overall")]


def test_native_normal_cdf_matches_erfc(spark):
    from cohortscope.functions.stats import normal_cdf
    xs = [i / 8 for i in range(-320, 321)] + [None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"))
    for r in got.collect():
        if r.x is None:
            assert r.p is None
        else:
            assert abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-13, r.x


def test_less_alternative_modes(spark):
    base = spark.createDataFrame([(0, "m", "binary", "less", 500, 500, 0.3, None, 2, "ok")],
                                 "metric_order int, metric string, type string, alternative string, "
                                 "n_per_group long, n_test long, baseline double, baseline_std double, "
                                 "n_arms long, status string")
    ref = SN.mde_table(base, mode="reference").first()
    assert ref.status == "unreachable" and ref.mde_abs is None
    d = SN.mde_table(base).first().mde_abs
    assert d < 0
    # power of the one-sided 'less' test at the reported effect is the target
    p1, p2 = 0.3, 0.3 + d
    se = math.sqrt(p1 * (1 - p1) / 500 + p2 * (1 - p2) / 500)
    assert abs(N.cdf(N.inv_cdf(0.05) - d / se) - 0.8) < 1e-4   # mde_abs is rounded to 6 digits


def test_sample_size_formula(spark):
    rows = [("A", float(x)) for x in (1, 2, 3, 4, 10)] + [("B", float(x)) for x in (2, 2, 5, 9)]
    df = spark.createDataFrame(rows, "split string, purch_amount double")
    got = SN.sample_size(df, mde=2.0).first()
    import statistics as st
    va, vb = st.variance([1, 2, 3, 4, 10]), st.variance([2, 2, 5, 9])
    want = math.ceil((N.inv_cdf(0.95) + N.inv_cdf(0.8)) ** 2 * (va + vb) / 4.0)
    assert got.sample_size == want and got.clean_split == "A"


def test_bootstrap_diff_statistics_against_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(11)
    a = rnd.integers(0, 40, 300).astype(float)
    b = rnd.integers(5, 45, 250).astype(float)
    rows = [("g", "ctl", float(x)) for x in a] + [("g", "trt", float(x)) for x in b]
    df = spark.createDataFrame(rows, "grp string, arm string, v double")
    med = B.bootstrap_diff(df, by=("grp",), value="v", split="arm", statistic="median",
                           n_boot=4000).first()
    assert med.clean_split == "ctl" and med.clean_value == float(np.median(a))
    assert med.observed_difference == float(np.median(b) - np.median(a))
    # reference resampling bootstrap of the median difference
    ref = [np.median(rnd.choice(b, b.size)) - np.median(rnd.choice(a, a.size)) for _ in range(4000)]
    assert abs(med.ci_lower - np.percentile(ref, 5)) <= 1.0
    assert abs(med.ci_upper - np.percentile(ref, 95)) <= 1.0
    cnt = B.bootstrap_diff(df, value="v", split="arm", statistic="count", n_boot=500).first()
    assert cnt.observed_difference == -50 and cnt.ci_lower == cnt.ci_upper == -50
    flipped = B.bootstrap_diff(df, value="v", split="arm", control="trt", n_boot=500).first()
    assert flipped.clean_split == "trt" and flipped.observed_difference < 0


def test_exact_sum_keeps_small_and_large_values(spark):
    from cohortscope.functions.stats import exact_avg, exact_sum
    df = spark.createDataFrame([(4e-7, 1e30), (3e-7, 2e30), (None, None)], "a double, b double")
    r = df.agg(exact_avg(F.col("a")).alias("a"), exact_sum(F.col("b")).alias("b")).first()
    assert abs(r.a - 3.5e-7) < 1e-18 and abs(r.b / 3e30 - 1) < 1e-12
    assert df.limit(0).agg(exact_sum(F.col("a")).alias("a")).first().a is None


def test_json_strings_that_look_like_objects(spark):
    from cohortscope.functions import json_fields as J
    text = '{"age": "{x", "email": "[a]b", "country_code": {"a": 1}, "upsell_order": [1]}'
    df = J.with_metadata(spark.createDataFrame([(text,)], "event_metadata string"), keys=["age", "email", "country_code", "upsell_order"])
    assert tuple(df.first().meta) == ("{x", "[a]b", None, None)
    assert df.select(J.json_value("event_metadata", "age")).first()[0] == "{x"


def test_null_slices_are_slices(spark):
    from cohortscope.operators import upsell
    ud = _user_df(spark, _rows(n=80)).withColumn("subscription", F.when(F.col("geo") == "T1", F.lit("1Week")))
    got = {(r.subscription, r.split) for r in upsell.arm_comparison(ud, by=("subscription",)).collect()}
    assert got == {(s, a) for s in ("1Week", None) for a in ("A", "B")}


def test_narrow_metric_is_cut_into_bounded_ranges(spark):
    """Values within one sixteenth of an octave: deeper ranges, the same replicates, no draws joined onto values."""
    import numpy as np
    df = spark.range(12_000).select(F.lit("g").alias("grp"), F.when(F.col("id") % 2 == 0, "ctl").otherwise("trt").alias("arm"),
                                    (1000 + F.col("id") / 12_000 + F.when(F.col("id") % 1000 == 1, 1e-9).otherwise(0.0)).alias("v"))
    whole, cut = (B.bootstrap_diff(df, by=("grp",), value="v", split="arm", n_boot=40, max_task_values=most).collect() for most in (10 ** 9, 300))
    assert whole == cut and whole[0].n_boot == 40
    a, b = (B.bootstrap_diff(df.where("id < 1000"), by=("grp",), value="v", split="arm", statistic="median", n_boot=40, max_task_values=most).collect() for most in (10 ** 9, 30))
    assert a == b
    values = df.where("arm = 'ctl'").select("grp", "v").withColumn("value", F.col("v"))
    ranged = B._ranged(values, ["grp"], 300).groupBy("level", "prefix").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert sum(r.n for r in ranged) == 6_000 and max(r.n for r in ranged) <= 300
    assert all(a.hi < b.lo for a, b in zip(ranged, ranged[1:]))  # ranges do not overlap
    assert {r.level for r in ranged} - {B.LEVELS[0]}
    # equal values stay together at any limit
    one = B._ranged(values, ["grp"], 0).groupBy("level", "prefix").agg(F.count_distinct("value").alias("n")).agg(F.max("n")).first()[0]
    assert one == 1
    plan = B.bootstrap_diffs(spark.createDataFrame([("o", "s", 1, "clean", "mean", 1.0, 3), ("o", "s", 1, "test", "mean", 2.0, 3)],
                                                   "axis string, segment string, metric_id int, role string, statistic string, value double, cnt long"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan or "FlatMapCoGroupsInArrow" in plan
    assert "draws" not in plan


def test_paths_give_the_draws_of_the_tree():
    """Following a path gives the same draws as splitting all of them."""
    import numpy as np
    rng = np.random.default_rng(2)
    values = np.unique(np.concatenate((rng.normal(0, 5, 300), [0.0, -1.5, 1e300, -1e-300])))
    counts, keys = rng.integers(1, 9, len(values)), B.order_keys(values)
    n, seeds = int(counts.sum()), [7, 1, 0, 0]
    draws = [B._follow(p, n, 50, seeds) for p in B._paths(keys, counts)]
    assert (sum(d for d, _ in draws) == n).all()
    below = np.zeros(50, np.int64)
    for d, before in draws:
        assert (before == below).all()
        below = below + d
    total = B._total(values, keys, counts, np.full(50, n), np.zeros(50, np.int64), n, seeds, "sum")
    assert np.allclose(total, sum(d * v for (d, _), v in zip(draws, values)))


def test_segments_with_a_named_control(spark):
    rows = [("B" if r[1] == "A" else "A", r) for r in _rows(n=200)]
    ud = _user_df(spark, [r for _, r in rows])
    by_name, named = ({(r.axis, r.segment, r.metric_id): r for r in B.bootstrap_segments(ud, n_boot=200, axes=(), control=c).collect()} for c in (None, "B"))
    assert by_name.keys() == named.keys() and all(r.clean_split == "A" for r in by_name.values())
    for k, r in named.items():
        assert (r.clean_split, r.test_split) == ("B", "A") and r.observed_difference == -by_name[k].observed_difference
    assert B.bootstrap_segments(ud, n_boot=200, control="C").count() == 0
