"""Onboarding funnel: daily step counts, conversions, slices, completion.

The analysts' query full-outer-joins funnel and app events on
``(user_id, day)`` and then takes distinct counts per day. Every output is a
distinct count (or ANY_VALUE) over one side, and the day is a join key, so
each row of either side lands in its own day whether it matched or not: the
same result comes from ``unionByName`` of both sides and one ``groupBy``.
That removes the join (whose output grows with events-per-user-day squared)
and leaves shuffles that combine map-side. An event belongs to one step, and a
step counts one kind of id, so the five conditional distinct counts need no
copy of a row for each of them (``Expand``): rows are combined to one per
(day, id) with a bit for each step reached, and the bits are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions import enrich, json_fields as J
from cohortscope.functions import windows as W
from cohortscope.operators.volume import events_named, exclude_country

STEPS = ("s1_path_selected", "s2_email_submit", "s3_subscribe", "s4_signup", "s5_upsell_view")


def _funnel_side(funnel: DataFrame, start, end) -> DataFrame:
    f = exclude_country(events_named(funnel, *config.FUNNEL_EVENTS))
    f = J.with_metadata(W.between_ts(f, start, end))
    return f.select(F.lit("f").alias("side"), "user_id", "device_id", "event_name",
                    F.to_date("timestamp").alias("event_date"),
                    F.col("country_code"),
                    J.meta("funnel_version").alias("funnel_version"))


def _app_side(app: DataFrame, start, end) -> DataFrame:
    w = W.between_ts(events_named(app, config.SIGNUP_CLICK, config.UPSELL_VIEW), start, end)
    return w.select(F.lit("w").alias("side"), "user_id", "event_name",
                    F.to_date("timestamp").alias("event_date"))


def _counted(rows: DataFrame, by: list[str], *more) -> tuple[DataFrame, list]:
    """Rows per (``by``, id) with the steps reached, and the sums that count them: distinct devices for step 1,
    users for the others. ``more``: aggregates to carry along."""
    name, is_f = F.col("event_name"), F.col("side") == "f"
    path = is_f & name.like(config.PATH_EVENT_LIKE)
    step = (F.when(path, 1).when(is_f & (name == config.EMAIL_SUBMIT), 2).when(is_f & (name == config.SUBSCRIBE), 4)
            .when(~is_f & (name == config.SIGNUP_CLICK), 8).when(~is_f & (name == config.UPSELL_VIEW), 16).otherwise(0))
    ids = rows.withColumn("__device", path).withColumn("__id", F.when(path, F.col("device_id")).otherwise(F.col("user_id")))
    per = ids.groupBy(*by, "__device", "__id").agg(F.bit_or(step).alias("__steps"), *more)
    known = F.col("__id").isNotNull()
    counts = [F.coalesce(F.sum(F.when(known, F.call_function("getbit", F.col("__steps"), F.lit(k)).cast("long"))), F.lit(0)).alias(s) for k, s in enumerate(STEPS)]
    return per, counts


def funnel_daily(funnel: DataFrame, app: DataFrame, start, end) -> DataFrame:
    """Per-day distinct devices/users reaching each of the five steps.

    Steps are unordered (no step requires the previous one); step 1 counts
    devices, the others users. ``funnel_version`` is one value seen that day
    (the minimum, so the result is deterministic).
    """
    both = _funnel_side(funnel, start, end).unionByName(_app_side(app, start, end),
                                                         allowMissingColumns=True)
    per, counts = _counted(both, ["event_date"], F.min("funnel_version").alias("funnel_version"))
    return per.groupBy("event_date").agg(F.min("funnel_version").alias("funnel_version"), *counts).orderBy(F.desc("event_date"))


def _ratio(num: str, den: str):
    return F.round(F.when(F.col(den) != 0, F.col(num) / F.col(den)), 6)


def funnel_conversion(daily: DataFrame) -> DataFrame:
    """Adjacent step-to-step conversion rates on ``funnel_daily`` output."""
    return daily.select(
        "*",
        _ratio("s2_email_submit", "s1_path_selected").alias("cr_path_to_email"),
        _ratio("s3_subscribe", "s2_email_submit").alias("cr_email_to_sub"),
        _ratio("s4_signup", "s3_subscribe").alias("cr_sub_to_signup"),
        _ratio("s5_upsell_view", "s4_signup").alias("cr_signup_to_upsell"),
    )


def funnel_by_version_geo(funnel: DataFrame, app: DataFrame, start, end) -> DataFrame:
    """Daily step counts sliced by funnel version and geo of the funnel events.

    App events inherit the slices of the same user's funnel events that day
    (as rows of the join would); app events of a user without funnel events
    that day fall into the ``(NULL, NULL)`` slice. The attribution joins
    distinct ``(user, day, step)`` with distinct ``(user, day, version, geo)``
    rows, so its size is bounded by users x days, not by events.
    """
    f = _funnel_side(funnel, start, end).withColumn("geo", enrich.geo_bucket("country_code"))
    f_rows = f.select("side", "user_id", "device_id", "event_name", "event_date",
                      "funnel_version", "geo")
    keys = (f.where(F.col("user_id").isNotNull())
            .select("user_id", "event_date", "funnel_version", "geo").distinct())
    w = _app_side(app, start, end).distinct()
    w_rows = w.join(keys, ["user_id", "event_date"], "left")
    both = f_rows.unionByName(w_rows, allowMissingColumns=True)
    per, counts = _counted(both, ["event_date", "funnel_version", "geo"])
    return per.groupBy("event_date", "funnel_version", "geo").agg(*counts)


def onboarding_completion(funnel: DataFrame, now, days: int = 30) -> DataFrame:
    """Share of users with a path event who subscribed after their first one.

    "Subscribed after the first path event" is ``max(subscribe ts) >
    min(path ts)``, so both come from one aggregation per user (map-side
    combined; no join, no per-user event list). Grouped by the day of the
    user's first path event.
    """
    df = events_named(funnel, *config.PATH_EVENTS, config.SUBSCRIBE)
    df = W.last_days(df, days, now).where(enrich.valid_user_id("user_id"))
    is_path = F.col("event_name").isin(*config.PATH_EVENTS)
    per_user = (df.groupBy("user_id")
                .agg(F.min(F.when(is_path, F.col("timestamp"))).alias("first_path_ts"),
                     F.max(F.when(~is_path, F.col("timestamp"))).alias("last_sub_ts"))
                .where(F.col("first_path_ts").isNotNull()))
    done = F.col("last_sub_ts") > F.col("first_path_ts")
    return (per_user.groupBy(F.to_date("first_path_ts").alias("path_date"))
            .agg(F.count(F.lit(1)).alias("path_users"),
                 F.count(F.when(done, F.lit(1))).alias("completed_users"))
            .withColumn("completion_rate",
                        F.round(F.col("completed_users") / F.col("path_users"), 6)))
