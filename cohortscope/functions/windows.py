"""Look-back windows over the event log.

Every window filters the timestamp *and*, when the frame has it, the
materialised ``event_date`` partition column: ``to_date(ts)`` is not mapped
to a partition column by Catalyst, so the explicit date predicate is what
prunes partitions. On a plain parquet column the timestamp predicate is
pushed to the row-group filter.

``now`` is always an argument (a ``datetime``); no operator reads the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "timestamp"
DATE_COL = "event_date"


def as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def ts_lit(value) -> Column:
    """Timestamp literal without time zone (the event log is NTZ)."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def _has(df: DataFrame, col: str) -> bool:
    return col in df.columns


def last_days(df: DataFrame, days: int | None, now, ts: str = TS,
              date_col: str = DATE_COL) -> DataFrame:
    """``DATE(ts) BETWEEN today - days AND today`` (both ends inclusive).

    ``days=None`` leaves the scan unbounded.
    """
    if days is None:
        return df
    today = as_date(now)
    lo = today - dt.timedelta(days=days)
    day = F.col(date_col) if _has(df, date_col) else F.to_date(F.col(ts))
    out = df.where(day.between(F.lit(lo), F.lit(today)))
    if _has(df, date_col):
        # same bounds on the timestamp so row groups are skipped too
        out = out.where((F.col(ts) >= ts_lit(lo)) &
                        (F.col(ts) < ts_lit(today + dt.timedelta(days=1))))
    return out


def since_days(df: DataFrame, days: int | None, now, ts: str = TS,
               date_col: str = DATE_COL) -> DataFrame:
    """``DATE(ts) >= today - days`` (open upper end)."""
    if days is None:
        return df
    lo = as_date(now) - dt.timedelta(days=days)
    out = df.where(F.col(ts) >= ts_lit(lo))
    if _has(df, date_col):
        out = out.where(F.col(date_col) >= F.lit(lo))
    return out


def between_ts(df: DataFrame, start, end, ts: str = TS,
               date_col: str = DATE_COL) -> DataFrame:
    """``ts BETWEEN start AND end`` with matching partition bounds."""
    start, end = as_datetime(start), as_datetime(end)
    out = df.where(F.col(ts).between(ts_lit(start), ts_lit(end)))
    if _has(df, date_col):
        out = out.where(F.col(date_col).between(F.lit(start.date()), F.lit(end.date())))
    return out


def since_ts(df: DataFrame, start, ts: str = TS, date_col: str = DATE_COL) -> DataFrame:
    """``ts >= start``."""
    start = as_datetime(start)
    out = df.where(F.col(ts) >= ts_lit(start))
    if _has(df, date_col):
        out = out.where(F.col(date_col) >= F.lit(start.date()))
    return out


def last_hours(df: DataFrame, days: int, now, ts: str = TS, date_col: str = DATE_COL) -> DataFrame:
    """``ts BETWEEN now - days AND now`` (timestamp window)."""
    now = as_datetime(now)
    return between_ts(df, now - dt.timedelta(days=days), now, ts, date_col)


def date_range(col: str | Column, start=None, end=None) -> Column:
    """``DATE(col)`` within [start, end]; either end may be open."""
    day = F.to_date(F.col(col) if isinstance(col, str) else col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (day >= F.lit(as_date(start)))
    if end is not None:
        cond = cond & (day <= F.lit(as_date(end)))
    return cond


def day_bounds(df: DataFrame, lo=None, hi=None, ts: str = TS, date_col: str = DATE_COL) -> Column:
    """Condition ``DATE(ts)`` within [lo, hi] (either end may be open), on the timestamp
    and, where the frame has it, on the partition column. As a condition it can stand
    in a disjunction of event kinds; the partitions read are then the union of theirs.
    """
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(ts) >= ts_lit(as_date(lo)))
    if hi is not None:
        cond = cond & (F.col(ts) < ts_lit(as_date(hi) + dt.timedelta(days=1)))
    if _has(df, date_col):
        if lo is not None:
            cond = cond & (F.col(date_col) >= F.lit(as_date(lo)))
        if hi is not None:
            cond = cond & (F.col(date_col) <= F.lit(as_date(hi)))
    return cond


def micros_to_ts(col: str | Column) -> Column:
    """Epoch microseconds -> TIMESTAMP_NTZ (UTC wall clock, session-TZ free)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MICROSECOND", c, ts_lit(dt.datetime(1970, 1, 1)))
