"""Column-level enrichments: geo, demographics, user agent, experiment split.

Each function maps Columns to a Column with native expressions only, so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortscope import config


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def geo_bucket(country: str | Column) -> Column:
    """'T1' for tier-1 countries, 'WW' otherwise (NULL included)."""
    c = _c(country)
    return F.when(c.isin(*config.T1_COUNTRIES), F.lit("T1")).otherwise(F.lit("WW"))


def clean_age(age: str | Column) -> Column:
    c = _c(age)
    return F.when(c.isNull() | (c == ""), F.lit("other")).otherwise(c)


def normalize_gender(gender: str | Column) -> Column:
    c = _c(gender)
    return (F.when(c.isin(*config.FEMALE_VALUES), F.lit("Female"))
            .when(c.isin(*config.MALE_VALUES), F.lit("Male"))
            .otherwise(F.lit("other")))


def normalize_payment_method(method: str | Column) -> Column:
    c = _c(method)
    return F.when(c == "apple_pay", F.lit("applepay")).otherwise(c)


def utm_bucket(source: str | Column) -> Column:
    c = _c(source)
    return (F.when(c.isin(*config.FACEBOOK_UTM), F.lit("facebook"))
            .when(c.isin(*config.KEPT_UTM), c)
            .otherwise(F.lit("other")))


def _first_match(ua: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    out = None
    for pattern, label in rules:
        cond = ua.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def device_type(user_agent: str | Column) -> Column:
    ua = _c(user_agent)
    return (F.when(ua.rlike(config.MOBILE_UA_PATTERN), F.lit("Mobile"))
            .when(ua.rlike(config.DESKTOP_UA_PATTERN), F.lit("Desktop"))
            .otherwise(F.lit("Unknown")))


def browser(user_agent: str | Column) -> Column:
    ua = _c(user_agent)
    return (F.when(ua.rlike("Chrome") & ~ua.rlike("Edg|OPR"), F.lit("Chrome"))
            .when(ua.rlike("Edg"), F.lit("Edge"))
            .when(ua.rlike("Firefox"), F.lit("Firefox"))
            .when(ua.rlike("Safari") & ~ua.rlike("Chrome"), F.lit("Safari"))
            .otherwise(F.lit("Other")))


def operating_system(user_agent: str | Column) -> Column:
    return _first_match(_c(user_agent), config.OS_RULES, "Other")


def device_model(user_agent: str | Column,
                 rules: Sequence[tuple[str, str]] = config.DEVICE_MODEL_RULES) -> Column:
    return _first_match(_c(user_agent), rules, "other")


def url_param(url: str | Column, pattern: str = config.UPSELL_VERSION_URL_PATTERN) -> Column:
    """First capture group of ``pattern``; NULL when it does not match."""
    return F.nullif(F.regexp_extract(_c(url), pattern, 1), F.lit(""))


def experiment_split(meta_version: str | Column, referrer: str | Column) -> Column:
    """Upsell split: metadata first, then the ``upsell_version`` URL parameter."""
    return F.coalesce(_c(meta_version), url_param(referrer))


def path_type(event_name: str | Column) -> Column:
    c = _c(event_name)
    return (F.when(c == config.SCALE_PATH, F.lit("scale_path"))
            .when(c == config.ESCAPE_PATH, F.lit("escape_path"))
            .when(c == config.SIMPLIFY_PATH, F.lit("simplify_path"))
            .when(c == config.STARTER_PATH, F.lit("starter_path")))


def upsell_order_of(rebill_count: str | Column) -> Column:
    """Payment rebill code -> upsell slot ('1' or '2'); NULL for other codes."""
    c = _c(rebill_count)
    out = None
    for order, codes in config.REBILL_BY_ORDER.items():
        cond = c.isin(*codes)
        out = F.when(cond, F.lit(order)) if out is None else out.when(cond, F.lit(order))
    return out


def flag(cond: Column) -> Column:
    """Boolean (NULL = false) -> 0/1 integer flag."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def present(col: str | Column) -> Column:
    return flag(_c(col).isNotNull())


def valid_user_id(user_id: str | Column) -> Column:
    c = _c(user_id)
    return c.isNotNull() & (c != config.UNDEFINED_USER)


def retention_buckets(mode: str = "reference") -> tuple[tuple[str, int], ...]:
    """(label, inclusive upper bound in minutes) per bucket.

    ``reference``: Day 0..Day 7, then one 'Day 30' bucket for minutes
    11521..44640. ``daily``: one bucket per day up to Day 30
    (44640 = 31 * 1440 minutes closes day 30).
    """
    if mode == "reference":
        return config.RETENTION_BUCKETS
    if mode == "daily":
        return tuple((f"Day {d}", (d + 1) * config.MINUTES_PER_DAY)
                     for d in range(config.DAILY_RETENTION_LAST_DAY + 1))
    raise ValueError(f"unknown retention bucket mode {mode!r}")


def retention_bucket(minutes: str | Column, mode: str = "reference") -> Column:
    """Bucket label for a whole-minute difference; NULL difference -> '> 30'."""
    m = _c(minutes)
    out = None
    for label, upper in retention_buckets(mode):
        cond = m <= upper
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(config.RETENTION_OVERFLOW))
