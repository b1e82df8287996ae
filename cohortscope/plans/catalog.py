"""Named queries over the generated tables, with fixed parameters.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from
the whole input tables. Parameters (reference time, windows, arms) are the
module constants below; the DuckDB oracle in ``plans.oracle`` uses the same
values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortscope.sources import driver_tables

# Reference time of every catalogued query; the generated events span
# 2024-01-01 .. 2024-01-30.
NOW = dt.datetime(2024, 1, 31)
ARMS = ("u15.3.1", "u15.4.1")
VIEW_START = dt.date(2024, 1, 8)
VIEW_END = dt.date(2024, 1, 23)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def sources(spark: SparkSession, sf_dir: str) -> driver_tables.Sources:
    return driver_tables.load(spark, sf_dir)


# --- volume ---------------------------------------------------------------

from cohortscope.operators import volume as V  # noqa: E402


@query("daily_volume")
def _daily_volume(spark, sf_dir):
    return V.daily_volume(sources(spark, sf_dir).funnel, NOW, days=30)


@query("top_events")
def _top_events(spark, sf_dir):
    return V.top_events(sources(spark, sf_dir).funnel, NOW, days=14, k=25)


@query("geo_split")
def _geo_split(spark, sf_dir):
    return V.geo_split(sources(spark, sf_dir).funnel, NOW, days=30)


@query("upsell_version_volume")
def _upsell_version_volume(spark, sf_dir):
    return V.upsell_version_volume(sources(spark, sf_dir).app, NOW, days=14, k=20)


@query("path_distribution")
def _path_distribution(spark, sf_dir):
    return V.path_distribution(sources(spark, sf_dir).funnel, NOW, days=7)


@query("segmentation")
def _segmentation(spark, sf_dir):
    return V.segmentation(sources(spark, sf_dir).funnel, NOW, days=7, k=50)


# --- funnel ---------------------------------------------------------------

from cohortscope.operators import funnel as FN  # noqa: E402

FUNNEL_START = NOW - dt.timedelta(days=14)


@query("funnel_daily")
def _funnel_daily(spark, sf_dir):
    s = sources(spark, sf_dir)
    return FN.funnel_daily(s.funnel, s.app, FUNNEL_START, NOW)


@query("funnel_conversion")
def _funnel_conversion(spark, sf_dir):
    s = sources(spark, sf_dir)
    return FN.funnel_conversion(FN.funnel_daily(s.funnel, s.app, FUNNEL_START, NOW))


@query("funnel_by_version_geo")
def _funnel_by_version_geo(spark, sf_dir):
    s = sources(spark, sf_dir)
    return FN.funnel_by_version_geo(s.funnel, s.app, FUNNEL_START, NOW)


@query("onboarding_completion")
def _onboarding_completion(spark, sf_dir):
    return FN.onboarding_completion(sources(spark, sf_dir).funnel, NOW, days=30)


# --- cohort, identity, retention -----------------------------------------

from cohortscope.operators import identity as ID  # noqa: E402
from cohortscope.operators import retention as R  # noqa: E402


@query("subscription_cohort")
def _subscription_cohort(spark, sf_dir):
    return R.subscription_cohort(sources(spark, sf_dir).funnel, NOW, days=60)


@query("first_unsubscribe")
def _first_unsubscribe(spark, sf_dir):
    from cohortscope import config
    return R.first_event(sources(spark, sf_dir).app, config.UNSUBSCRIBED, NOW, days=90)


@query("device_user_map")
def _device_user_map(spark, sf_dir):
    return ID.device_user_map(sources(spark, sf_dir).funnel, NOW, days=180)


@query("user_path")
def _user_path(spark, sf_dir):
    f = sources(spark, sf_dir).funnel
    return ID.user_path(f, R.subscription_cohort(f, NOW, 60), NOW, days=180, cohort_days=60)


@query("registration_device")
def _registration_device(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.registration_device(R.subscription_cohort(s.funnel, NOW, 60), s.app, NOW, days=90)


@query("retention_rows")
def _retention_rows(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_rows(s.funnel, s.app, NOW)


@query("retention_matrix")
def _retention_matrix(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_matrix(s.funnel, s.app, NOW, kind="lessons")


@query("retention_matrix_ai")
def _retention_matrix_ai(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_matrix(s.funnel, s.app, NOW, kind="ai")


@query("retention_matrix_geo")
def _retention_matrix_geo(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_matrix(s.funnel, s.app, NOW, kind="lessons", by=("geo",))


@query("retention_daily")
def _retention_daily(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_daily(s.funnel, s.app, NOW, kind="lessons")


# --- upsell pull and dashboards -------------------------------------------

from cohortscope.operators import experiment as X  # noqa: E402
from cohortscope.operators import upsell as U  # noqa: E402
from cohortscope.operators.prefilter import BITS  # noqa: E402


def pull(spark, sf_dir, experiment: bool = False):
    s = sources(spark, sf_dir)
    if experiment:
        return U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, NOW, days=30,
                                   arms=ARMS, view_start=VIEW_START, view_end=VIEW_END,
                                   decline_flag=True)
    return U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, NOW, days=30)


@query("upsell_cash")
def _upsell_cash(spark, sf_dir):
    return U.upsell_cash(sources(spark, sf_dir).payments, NOW, days=30)


@query("upsell_declines")
def _upsell_declines(spark, sf_dir):
    return U.upsell_declines(sources(spark, sf_dir).payments, NOW, days=30)


@query("refund_tickets")
def _refund_tickets(spark, sf_dir):
    return U.refund_tickets(sources(spark, sf_dir).tickets)


@query("insufficient_fund_events")
def _insufficient_fund_events(spark, sf_dir):
    return U.insufficient_fund_events(sources(spark, sf_dir).app, NOW, days=30)


@query("upsell_user_level")
def _upsell_user_level(spark, sf_dir):
    return pull(spark, sf_dir)


@query("upsell_user_level_prefiltered")
def _upsell_user_level_prefiltered(spark, sf_dir):
    s = sources(spark, sf_dir)
    return U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, NOW, days=30, prefilter_bits=BITS)


@query("experiment_pull")
def _experiment_pull(spark, sf_dir):
    return pull(spark, sf_dir, experiment=True)


@query("upsell_gain")
def _upsell_gain(spark, sf_dir):
    return U.upsell_gain(X.to_user_level(pull(spark, sf_dir)), by=("geo",))


@query("median_time_to_ttp")
def _median_time_to_ttp(spark, sf_dir):
    return U.median_time_to_ttp(sources(spark, sf_dir).app, X.to_user_level(pull(spark, sf_dir)),
                                by=("geo",))


@query("traffic_composition")
def _traffic_composition(spark, sf_dir):
    return U.traffic_composition(pull(spark, sf_dir))


@query("arm_comparison")
def _arm_comparison(spark, sf_dir):
    return U.arm_comparison(X.to_user_level(pull(spark, sf_dir)))


@query("unsub_ratio")
def _unsub_ratio(spark, sf_dir):
    return U.unsub_ratio(pull(spark, sf_dir, experiment=True))


# --- experiment analysis ---------------------------------------------------

def user_level(spark, sf_dir):
    """The experiment's user-level table, checkpointed once into the shared
    folder: every analysis below (estimates, bootstrap, sensitivity) reads it
    instead of re-running the pull in each of its branches."""
    from cohortscope.sources.sinks import cut_lineage
    return cut_lineage(X.to_user_level(pull(spark, sf_dir, experiment=True)))


@query("user_level")
def _user_level(spark, sf_dir):
    return user_level(spark, sf_dir)


@query("metric_point_estimates")
def _metric_point_estimates(spark, sf_dir):
    return X.metric_point_estimates(user_level(spark, sf_dir))


@query("segment_point_estimates")
def _segment_point_estimates(spark, sf_dir):
    return X.segment_point_estimates(user_level(spark, sf_dir))


# --- bootstrap, report, sensitivity, long table ----------------------------

from cohortscope.operators import bootstrap as B  # noqa: E402
from cohortscope.operators import report as RP  # noqa: E402
from cohortscope.operators import sensitivity as SN  # noqa: E402


@query("bootstrap_full")
def _bootstrap_full(spark, sf_dir):
    return B.bootstrap_segments(user_level(spark, sf_dir), n_boot=10_000, seed=42, level=0.95)


@query("summary_report")
def _summary_report(spark, sf_dir):
    from cohortscope.sources.sinks import cut_lineage
    # the report reads the (small) results twice: checkpoint them once
    return RP.summary_lines(cut_lineage(B.bootstrap_segments(user_level(spark, sf_dir), n_boot=10_000)))


@query("sample_size")
def _sample_size(spark, sf_dir):
    return SN.sample_size(user_level(spark, sf_dir), "purch_amount", mde=8.0, alternative="greater")


@query("mde_table")
def _mde_table(spark, sf_dir):
    return SN.mde_table(SN.baselines(user_level(spark, sf_dir)), power=0.8)


@query("power_z")
def _power_z(spark, sf_dir):
    return SN.power_z(SN.baselines(user_level(spark, sf_dir)))


@query("power_table")
def _power_table(spark, sf_dir):
    return SN.power_table(SN.baselines(user_level(spark, sf_dir)))


@query("long_metrics")
def _long_metrics(spark, sf_dir):
    return X.to_long(X.segment_point_estimates(user_level(spark, sf_dir)))


# --- remaining cohort inputs and dashboard slices ---------------------------

@query("lesson_activity")
def _lesson_activity(spark, sf_dir):
    from cohortscope import config
    return R.activity(sources(spark, sf_dir).app, config.LESSON_EVENTS, NOW, days=90) \
        .withColumnRenamed("user_id", "ret_user_id").withColumnRenamed("timestamp", "ret_timestamp")


@query("ai_activity")
def _ai_activity(spark, sf_dir):
    from cohortscope import config
    return R.activity(sources(spark, sf_dir).app, config.AI_EVENTS, NOW, days=90) \
        .withColumnRenamed("user_id", "ret_ai_user_id").withColumnRenamed("timestamp", "ret_ai_timestamp")


@query("upsell_purchasers")
def _upsell_purchasers(spark, sf_dir):
    from cohortscope import config
    return R.event_users(sources(spark, sf_dir).app, config.UPSELL_PURCHASE, NOW, days=90) \
        .withColumnRenamed("user_id", "upsell_user_id")


@query("upsell_gain_by_plan")
def _upsell_gain_by_plan(spark, sf_dir):
    return U.upsell_gain(X.to_user_level(pull(spark, sf_dir)), by=("geo", "subscription"))


@query("arm_comparison_geo")
def _arm_comparison_geo(spark, sf_dir):
    return U.arm_comparison(X.to_user_level(pull(spark, sf_dir)), by=("geo",))


@query("current_test_pull")
def _current_test_pull(spark, sf_dir):
    s = sources(spark, sf_dir)  # the running test: its arms from a start date on
    return U.upsell_user_level(s.funnel, s.app, s.payments, s.tickets, NOW, days=30, arms=ARMS,
                               view_start=VIEW_START, decline_flag=True)


@query("retention_daily_geo")
def _retention_daily_geo(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.retention_daily(s.funnel, s.app, NOW, kind="lessons", by=("geo",))


@query("traffic_composition_geo")
def _traffic_composition_geo(spark, sf_dir):
    return U.traffic_composition(pull(spark, sf_dir), by=("geo",))


@query("unsub_ratio_by_plan")
def _unsub_ratio_by_plan(spark, sf_dir):
    return U.unsub_ratio(pull(spark, sf_dir, experiment=True), by=("subscription",))


@query("estimates_named_control")
def _estimates_named_control(spark, sf_dir):
    return X.metric_point_estimates(user_level(spark, sf_dir), control=ARMS[1])


@query("mde_two_sided")
def _mde_two_sided(spark, sf_dir):
    return SN.mde_table(SN.baselines(user_level(spark, sf_dir), alternative="two-sided", control=ARMS[1]))


@query("power_two_sided")
def _power_two_sided(spark, sf_dir):
    return SN.power_table(SN.baselines(user_level(spark, sf_dir), alternative="two-sided"))


def pull_with_ltv(spark, sf_dir):
    """The experiment pull exported as CSV with each user's settled total as ``ltv`` and read
    back, as the analysts do."""
    from pyspark.sql import functions as F
    from cohortscope.sources.events import UPSELL_PULL_SCHEMA, read_upsell_csv
    from cohortscope.sources.sinks import write_scratch_csv
    ltv = (sources(spark, sf_dir).payments.where(F.col("status") == "settled")
           .groupBy(F.col("customer_account_id").alias("user_id")).agg((F.sum("amount") / 100).alias("ltv")))
    rows = (pull(spark, sf_dir, experiment=True).drop("has_insufficient_funds_decline")
            .join(ltv, "user_id", "left").select(*UPSELL_PULL_SCHEMA.names))
    return read_upsell_csv(spark, write_scratch_csv(rows))


@query("ltv_estimates")
def _ltv_estimates(spark, sf_dir):
    return X.metric_point_estimates(X.to_user_level(pull_with_ltv(spark, sf_dir)))


@query("user_level_deduped")
def _user_level_deduped(spark, sf_dir):
    return X.to_user_level(pull(spark, sf_dir, experiment=True), dedupe_cash=True)


@query("estimates_documented")
def _estimates_documented(spark, sf_dir):
    return X.metric_point_estimates(user_level(spark, sf_dir), documented=True)


@query("early_unsubscribes")
def _early_unsubscribes(spark, sf_dir):
    s = sources(spark, sf_dir)
    return R.early_unsubscribes(s.funnel, s.app, NOW)


@query("mde_with_ltv")
def _mde_with_ltv(spark, sf_dir):
    return SN.mde_table(SN.baselines(X.to_user_level(pull_with_ltv(spark, sf_dir))))


@query("bootstrap_decided")
def _bootstrap_decided(spark, sf_dir):
    """What the bootstrap says of every analysed segment whatever is drawn: arms, estimates, sizes and direction."""
    return B.bootstrap_segments(user_level(spark, sf_dir), n_boot=200).drop("ci_lower", "ci_upper", "p_value", "significant")


@query("report_lines")
def _report_lines(spark, sf_dir):
    """The report of the segment estimates, with a fixed rule in place of the drawn decision."""
    from pyspark.sql import functions as F
    from cohortscope.sources.sinks import cut_lineage
    e = X.segment_point_estimates(user_level(spark, sf_dir))
    change = F.abs("relative_difference_pct")
    results = e.select("*", F.when(F.col("observed_difference") > 0, "positive").otherwise("negative").alias("direction"),
                       F.coalesce(change >= 60, F.lit(False)).alias("significant"), F.round(1 / (F.col("clean_n") + F.col("test_n")), 6).alias("p_value"))
    return RP.summary_lines(cut_lineage(results))


@query("daily_extract")
def _daily_extract(spark, sf_dir):
    """The daily volume as an extract: a first load of some days, a refresh of all, read by its manifest."""
    from pyspark.sql import functions as F
    from cohortscope.sources.sinks import read_extract, scratch_folder, write_extract
    daily, path = V.daily_volume(sources(spark, sf_dir).funnel, NOW, days=30), scratch_folder(spark, "extract")
    write_extract(daily.where(F.dayofmonth("event_date") % 2 == 0).withColumn("subscribes", F.lit(-1).cast("long")), path, "event_date")
    write_extract(daily, path, "event_date")
    return read_extract(spark, path).select(*daily.columns)
