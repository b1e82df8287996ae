"""Event-volume queries: daily subscriptions, top events, geo, versions, paths.

All are one filtered scan plus one aggregation; the aggregations combine
map-side, so a hot key costs one partial row per task before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions import enrich, json_fields as J
from cohortscope.functions import windows as W


def events_named(df: DataFrame, *names: str) -> DataFrame:
    if len(names) == 1:
        return df.where(F.col("event_name") == names[0])
    return df.where(F.col("event_name").isin(*names))


def exclude_country(df: DataFrame, country: str = config.EXCLUDED_COUNTRY,
                    source: str = "column") -> DataFrame:
    """``country != X``; a NULL country drops the row (three-valued logic)."""
    if source == "column":
        return df.where(F.col("country_code") != country)
    return df.where(J.meta("country_code") != country)


def daily_volume(funnel: DataFrame, now, days: int = 30, ascending: bool = False) -> DataFrame:
    """Subscribes and distinct subscribers per day over the last ``days`` days."""
    df = exclude_country(events_named(funnel, config.SUBSCRIBE))
    df = W.last_days(df, days, now)
    out = (df.groupBy(F.to_date("timestamp").alias("event_date"))
           .agg(F.count(F.lit(1)).alias("subscribes"),
                F.count_distinct("user_id").alias("unique_users")))
    return out.orderBy(F.col("event_date").asc() if ascending else F.col("event_date").desc())


def top_events(funnel: DataFrame, now, days: int = 14, k: int = 25) -> DataFrame:
    """The ``k`` most frequent event names in ``[now - days, now]``."""
    df = W.last_hours(funnel, days, now)
    return (df.groupBy("event_name").agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.desc("occurrences"), F.asc_nulls_first("event_name")).limit(k))


def geo_split(funnel: DataFrame, now, days: int = 30) -> DataFrame:
    """Subscribes per T1/WW bucket (country read from the event metadata)."""
    df = exclude_country(events_named(funnel, config.SUBSCRIBE))
    df = W.last_days(df, days, now)
    df = J.with_metadata(df)
    return (df.groupBy(enrich.geo_bucket(J.meta("country_code")).alias("geo"))
            .agg(F.count(F.lit(1)).alias("subscribes"))
            .orderBy(F.desc("subscribes"), F.asc("geo")))


def upsell_version_volume(app: DataFrame, now, days: int = 14, k: int = 20) -> DataFrame:
    """Distinct viewers per upsell version for views opened from registration."""
    df = W.last_hours(events_named(app, config.UPSELL_VIEW), days, now)
    df = (J.with_metadata(df)
          .transform(J.with_query_parameters)
          .where(J.meta("source", "qp") == config.REGISTER_SOURCE))
    split = enrich.experiment_split(J.meta("upsell_version"), F.col("referrer"))
    return (df.groupBy(split.alias("upsell_version"))
            .agg(F.count_distinct("user_id").alias("users"))
            .orderBy(F.desc("users"), F.asc_nulls_first("upsell_version")).limit(k))


def path_from_metadata(col: str = "meta"):
    return F.coalesce(J.meta("scale_path", col), J.meta("escape_path", col),
                      J.meta("starter_path", col), J.meta("simplify_path", col))


def path_distribution(funnel: DataFrame, now, days: int = 7) -> DataFrame:
    """Subscribes per quiz path recorded in the subscribe metadata."""
    df = exclude_country(events_named(funnel, config.SUBSCRIBE))
    df = J.with_metadata(W.since_ts(df, W.as_datetime(now) - dt.timedelta(days=days)))
    return (df.groupBy(path_from_metadata().alias("path_from_meta"))
            .agg(F.count(F.lit(1)).alias("subs"))
            .orderBy(F.desc("subs"), F.asc_nulls_first("path_from_meta")))


def segmentation(funnel: DataFrame, now, days: int = 7, k: int = 50) -> DataFrame:
    """Distinct subscribers by geo x funnel version, top ``k``."""
    df = exclude_country(events_named(funnel, config.SUBSCRIBE))
    df = J.with_metadata(W.since_ts(df, W.as_datetime(now) - dt.timedelta(days=days)))
    return (df.groupBy(enrich.geo_bucket(J.meta("country_code")).alias("geo"),
                       J.meta("funnel_version").alias("funnel_version"))
            .agg(F.count_distinct("user_id").alias("subscribers"))
            .orderBy(F.desc("subscribers"), F.asc("geo"), F.asc_nulls_first("funnel_version"))
            .limit(k))
