"""Identity resolution: device -> user map and the user's quiz path.

Both "latest value" lookups are written as ``max_by`` aggregations instead of
row-preserving ``FIRST_VALUE ... OVER (PARTITION BY ...)`` windows: the
aggregate combines map-side (a hot device or user costs one partial row per
task), and it returns one row per key, so joining it never multiplies rows.
Ties on the timestamp are broken by ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions import enrich, json_fields as J
from cohortscope.functions import windows as W
from cohortscope.operators.volume import events_named, path_from_metadata


def _latest(value: str):
    return F.max_by(F.col(value), F.struct(F.col("timestamp"), F.col("event_id")))


def device_user_map(funnel: DataFrame, now, days: int = 180) -> DataFrame:
    """``(device_id, mapped_user_id)``: the user of the device's latest e-mail submit."""
    df = events_named(funnel, config.EMAIL_SUBMIT).where(enrich.valid_user_id("user_id"))
    df = W.last_hours(df, days, now)
    return df.groupBy("device_id").agg(_latest("user_id").alias("mapped_user_id"))


def latest_path_by_user(funnel: DataFrame, cohort: DataFrame, device_map: DataFrame,
                        now, days: int = 180) -> DataFrame:
    """``(user_id, latest_path)``: latest path event attributed to each user.

    A path event counts when it happened on the device of a cohort row at or
    before that row's subscribe time: since any such row will do, the test
    is ``ts <= max(purch_timestamp)`` of the device, a one-row-per-device
    join instead of an inner join against every cohort row. The event's
    user is its own ``user_id`` when valid, else the device map's.
    """
    last_purchase = (cohort.groupBy("device_id")
                     .agg(F.max("purch_timestamp").alias("device_last_purchase")))
    pe = W.last_days(events_named(funnel, *config.PATH_EVENTS), days, now)
    pe = (pe.select("event_id", "user_id", "device_id", "event_name", "timestamp")
          .join(last_purchase, "device_id", "inner")
          .where(F.col("timestamp") <= F.col("device_last_purchase"))
          .join(device_map, "device_id", "left")
          .withColumn("resolved_user_id",
                      F.when(enrich.valid_user_id("user_id"), F.col("user_id"))
                      .otherwise(F.col("mapped_user_id")))
          .where(F.col("resolved_user_id").isNotNull())
          .withColumn("path_type", enrich.path_type("event_name")))
    return (pe.groupBy(F.col("resolved_user_id").alias("user_id"))
            .agg(_latest("path_type").alias("latest_path")))


def user_path(funnel: DataFrame, cohort: DataFrame, now, days: int = 180,
              cohort_days: int | None = 60) -> DataFrame:
    """Distinct ``(user_id, user_path)``: metadata path, else the latest path event.

    The metadata path is read from the user's subscribe events at the cohort
    rows' exact subscribe times (a semi-join on ``(user_id, timestamp)``);
    a user whose subscribes carry different paths keeps each of them.
    """
    entries = cohort.select("user_id", F.col("purch_timestamp").alias("timestamp")).distinct()
    subs = W.last_days(events_named(funnel, config.SUBSCRIBE), cohort_days, now)
    meta_path = (J.with_metadata(subs.join(entries, subs["user_id"].eqNullSafe(entries["user_id"]) & (subs["timestamp"] == entries["timestamp"]), "left_semi"))
                 .select("user_id", path_from_metadata().alias("path_from_meta")).distinct())
    latest = latest_path_by_user(funnel, cohort, device_user_map(funnel, now, days), now, days)
    return (meta_path.join(latest, "user_id", "left")
            .select("user_id", F.coalesce("path_from_meta", "latest_path").alias("user_path"))
            .distinct())
