"""Upsell pull: payments, declines, tickets, the user-level experiment table.

The analysts' pull joins subscribe events with signup clicks, upsell views,
purchase clicks, purchases, unsubscribes, settled cash, declines, tickets and
the insufficient-fund aggregates, and then DISTINCTs the projection. The
join multiplies rows by the per-user count of every event kind. Here the app
log is read once and reduced to one row per ``(user, slot)`` (``app_facts``):

* signup click: existence only;
* view: the distinct splits of the slot (IP test applied to the view row,
  which is what the WHERE clause does to the LEFT JOIN);
* purchase click: the distinct values of ``insufficient_fund == 'true'``;
* purchase: the distinct amounts;
* unsubscribe: ``min``/``max`` time per user -- ``unsub12h`` is 1 for some
  unsubscribe row iff the earliest is < 13 h after subscribe (whole hours,
  truncated) and 0 for some row iff the latest is >= 13 h after;
* cash / declines: distinct values per ``(user, upsell slot)`` after mapping
  the rebill code to its slot, which turns the OR join into an equi-join.

The sets hold distinct splits and prices of one slot, not events, and are
combined map-side, so a hot user costs one partial row per task and slot.
The result is the same DISTINCT row set.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions import enrich, json_fields as J
from cohortscope.functions import windows as W
from cohortscope.functions.stats import exact_avg, exact_sum
from cohortscope.operators.experiment import arm_order
from cohortscope.operators.prefilter import probable
from cohortscope.operators.selection import exact_median
from cohortscope.operators.volume import events_named


def _payments(payments: DataFrame) -> DataFrame:
    if "created_ts" in payments.columns:
        return payments
    return payments.withColumn("created_ts", W.micros_to_ts("created_at"))


def upsell_cash(payments: DataFrame, now, days: int = 30) -> DataFrame:
    """Settled upsell cash per customer and rebill code (amount in units)."""
    p = _payments(payments)
    p = p.where((F.col("created_ts") >= W.ts_lit(W.as_datetime(now) - dt.timedelta(days=days)))
                & (F.col("status") == "settled") & (F.col("payment_type") == "upsell")
                & F.col("rebill_count").isin(*config.UPSELL_REBILL_CODES))
    return (p.groupBy("customer_account_id", "rebill_count")
            .agg((F.sum("amount") / F.lit(100)).alias("purch_amount"),
                 F.count(F.lit(1)).alias("purch_count")))


def upsell_declines(payments: DataFrame, now, days: int = 30) -> DataFrame:
    """Upsell payments declined for insufficient funds (case-insensitive match)."""
    p = _payments(payments)
    p = p.where(F.col("rebill_count").isin(*config.UPSELL_REBILL_CODES)
                & (F.col("payment_type") == "upsell") & (F.col("status") == "declined")
                & W.date_range("created_ts", W.as_date(now) - dt.timedelta(days=days), W.as_date(now))
                & F.lower("decline_message").like(config.INSUFFICIENT_FUNDS_MESSAGE.lower()))
    return (p.groupBy("customer_account_id", "rebill_count")
            .agg(F.count(F.lit(1)).alias("declined_count"),
                 F.min("created_ts").alias("first_declined_at")))


def refund_tickets(tickets: DataFrame) -> DataFrame:
    """Distinct refund-tagged conversations per author e-mail."""
    return (tickets.where(F.lower("tag_name").like(config.REFUND_TAG_LIKE))
            .groupBy("author_email")
            .agg(F.count_distinct("conversation_id").alias("ticket_count")))


def event_first_and_count(app: DataFrame, name: str, now, days: int | None = 30) -> DataFrame:
    """``(user_id, first_at, n)`` of one event kind since ``today - days``."""
    df = W.since_days(events_named(app, name), days, now)
    return df.groupBy("user_id").agg(F.min("timestamp").alias("first_at"),
                                     F.count(F.lit(1)).alias("n"))


def insufficient_fund_events(app: DataFrame, now, days: int = 30) -> DataFrame:
    """Insufficient-fund modal views and clicks per user, long form (``kind``)."""
    view = event_first_and_count(app, config.INSUFFICIENT_FUND_VIEW, now, days)
    click = event_first_and_count(app, config.INSUFFICIENT_FUND_CLICK, now, days)
    return (view.withColumn("kind", F.lit("view"))
            .unionByName(click.withColumn("kind", F.lit("click"))))


def _rebill_slot(df: DataFrame) -> DataFrame:
    return (df.withColumn("upsell_order", enrich.upsell_order_of("rebill_count"))
            .where(F.col("upsell_order").isNotNull()))


SLOT_EVENTS = (config.UPSELL_VIEW, config.UPSELL_PURCHASE_CLICK, config.UPSELL_PURCHASE)
SLOT_KEYS = ("upsell_version", "upsell_order", "insufficient_fund", "upsell_amount")


def app_facts(app: DataFrame, now, days: int = 30, arms=None, view_start=None, view_end=None,
              app_days: int | None = None) -> DataFrame:
    """What each user did in each upsell slot, one row per ``(user_id, upsell_order)``.

    ``__views`` / ``__ttps`` / ``__buys`` are the distinct splits, click flags and
    amounts of the slot; ``__signup``, ``__viewer``, ``__u_min``, ``__u_max``,
    ``__ifv`` and ``__ifc`` are the user's, repeated on each of the user's slots.
    Events without a slot are under the NULL slot, whose clicks and purchases match
    no view. View dates prune the view's partitions in a scan of their own; all
    other kinds share one scan. Only slot events have their JSON parsed.
    """
    today = W.as_date(now)
    name = F.col("event_name")
    span = (W.day_bounds(app) if app_days is None
            else W.day_bounds(app, today - dt.timedelta(days=app_days), today))
    recent = W.day_bounds(app, today - dt.timedelta(days=days))
    shown = (name == config.UPSELL_VIEW) & span & W.day_bounds(app, view_start, view_end)
    other = ((name.isin(config.SIGNUP_CLICK, config.UNSUBSCRIBED, *SLOT_EVENTS[1:]) & span)
             | (name.isin(config.INSUFFICIENT_FUND_VIEW, config.INSUFFICIENT_FUND_CLICK) & recent))
    cols = ["user_id", "timestamp", "event_name", "ip", "referrer",
            *[F.when(name.isin(*SLOT_EVENTS), F.col(c)).alias(c) for c in ("event_metadata", "query_parameters")]]
    if view_start is None and view_end is None:
        scan = app.where(shown | other).select(*cols)
    else:
        scan = app.where(shown).select(*cols).unionByName(app.where(other).select(*cols))
    m = J.meta
    e = (J.with_metadata(scan.where(F.col("user_id").isNotNull()), keys=SLOT_KEYS)
         .transform(J.with_query_parameters)
         .where(~name.isin(*SLOT_EVENTS) | (m("source", "qp") == config.REGISTER_SOURCE))
         .select("user_id", "timestamp", "event_name", "ip", m("upsell_order").alias("upsell_order"),
                 m("upsell_amount").alias("upsell_amount"),
                 enrich.experiment_split(m("upsell_version"), "referrer").alias("split"),
                 F.coalesce(m("insufficient_fund") == "true", F.lit(False)).alias("short")))
    slot = F.col("upsell_order").isNotNull()
    view = (name == config.UPSELL_VIEW) & (F.col("ip") != config.EXCLUDED_IP)
    if arms is not None:
        view = view & F.col("split").isin(*arms)
    left = F.when(name == config.UNSUBSCRIBED, F.col("timestamp"))
    per_slot = e.groupBy("user_id", "upsell_order").agg(
        F.collect_set(F.when(view, F.struct("split"))).alias("__views"),
        F.collect_set(F.when(slot & (name == config.UPSELL_PURCHASE_CLICK), F.struct("short"))).alias("__ttps"),
        F.collect_set(F.when(slot & (name == config.UPSELL_PURCHASE), F.struct("upsell_amount"))).alias("__buys"),
        F.max(name == config.SIGNUP_CLICK).alias("__signup"),
        F.min(left).alias("__u_min"), F.max(left).alias("__u_max"),
        F.max(name == config.INSUFFICIENT_FUND_VIEW).alias("__ifv"),
        F.max(name == config.INSUFFICIENT_FUND_CLICK).alias("__ifc"))
    user = Window.partitionBy("user_id")  # a row per slot of the user
    return per_slot.withColumns({
        "__viewer": F.max(F.size("__views") > 0).over(user),
        **{c: F.max(c).over(user) for c in ("__signup", "__u_max", "__ifv", "__ifc")},
        "__u_min": F.min("__u_min").over(user)})


def upsell_user_level(funnel: DataFrame, app: DataFrame, payments: DataFrame,
                      tickets: DataFrame, now, days: int = 30, arms=None,
                      view_start=None, view_end=None, app_days: int | None = None,
                      decline_flag: bool = False, keep_non_viewers: bool = False,
                      declines_on: str = "purchase", prefilter_bits: int | None = None) -> DataFrame:
    """The 26-column upsell pull (DISTINCT rows), optionally narrowed to one test.

    ``arms`` / ``view_start`` / ``view_end`` restrict the upsell view (split
    and view date), as the experiment pulls do. ``app_days`` bounds the app
    event scans (``None`` = unbounded, as in the analysts' query).
    ``decline_flag`` adds ``has_insufficient_funds_decline``.
    ``keep_non_viewers`` applies the IP test inside the view join instead of
    after it, so subscribers without a view stay (``ups_view = 0``).
    ``declines_on="subscriber"`` matches declines on the subscriber even
    without a purchase event (the analysts' query keys them on the purchase).
    ``prefilter_bits`` drops app events of users who surely did not subscribe
    before JSON parsing and the shuffle, by a bitmap of that many bits (for
    logs far larger than the subscribers; it reads the subscriptions once more).
    """
    m = J.meta
    fun = W.since_days(events_named(funnel, config.SUBSCRIBE), days, now)
    fun = (J.with_metadata(fun)
           .where(m("country_code") != config.EXCLUDED_COUNTRY)
           .where(~m("card_type").isin(*config.EXCLUDED_CARD_TYPES))
           .where(m("channel") == config.EXPERIMENT_CHANNEL)
           .select("timestamp", "user_id",
                   m("email").alias("__email"),
                   m("subscription").alias("subscription"), m("channel").alias("channel"),
                   enrich.geo_bucket(m("country_code")).alias("geo"),
                   m("payment_method").alias("payment_method"),
                   m("utm_source").alias("utm_source"),
                   m("subscription_id").alias("subscription_id"),
                   m("funnel_version").alias("funnel_version"),
                   m("quiz_version").alias("quiz_version")))

    if prefilter_bits is not None:
        app = probable(app, fun.select("user_id"), "user_id", prefilter_bits)
    facts = app_facts(app, now, days, arms, view_start, view_end, app_days)
    viewed = F.size("__views") > 0
    if keep_non_viewers:  # the signup click gives every buyer a row without a slot
        viewed = viewed | (F.col("upsell_order").isNull() & ~F.col("__viewer"))
    facts = facts.where(F.col("__signup") & viewed)
    # at most two rebill codes map to one slot, so these sides stay small per
    # key without a DISTINCT of their own (the final DISTINCT collapses equal rows)
    cash = (_rebill_slot(upsell_cash(payments, now, days))
            .select(F.col("customer_account_id").alias("__cash_user"),
                    F.col("upsell_order").alias("__cash_order"), "purch_count", "purch_amount"))
    declines = (_rebill_slot(upsell_declines(payments, now, days))
                .select(F.col("customer_account_id").alias("__di_user"),
                        F.col("upsell_order").alias("__di_order"),
                        "declined_count", "first_declined_at"))
    tix = refund_tickets(tickets)

    # join order follows the keys so the wide side is repartitioned at most
    # three times at scale: user first, then (user, slot), then e-mail
    rows = (fun.join(facts, "user_id")
            .withColumn("__view", F.explode_outer("__views"))
            .withColumn("__ttp", F.explode_outer("__ttps"))
            .withColumn("__purch", F.explode_outer("__buys"))
            .withColumns({"split": F.col("__view.split"), "upsell_amount": F.col("__purch.upsell_amount"),
                          "__ttp_if": F.col("__ttp.short")}))
    bought = F.col("__purch").isNotNull()
    rows = (rows
            .join(cash, bought & (F.col("user_id") == F.col("__cash_user"))
                  & (F.col("upsell_order") == F.col("__cash_order")), "left")
            .join(declines, (bought if declines_on == "purchase" else F.lit(True))
                  & (F.col("user_id") == F.col("__di_user"))
                  & (F.col("upsell_order") == F.col("__di_order")), "left")
            .join(tix, (F.col("__email") == F.col("author_email")) & F.col("__email").isNotNull()
                  & (F.col("__email") != ""), "left"))

    cutoff = F.timestamp_add("HOUR", F.lit(13), F.col("timestamp"))
    unsub_values = F.when(
        bought & F.col("__u_min").isNotNull(),
        F.filter(F.array(F.when(F.col("__u_min") < cutoff, F.lit(1)),
                         F.when(F.col("__u_max") >= cutoff, F.lit(0))),
                 lambda x: x.isNotNull())
    ).otherwise(F.array(F.lit(0)))
    out = rows.select(
        "timestamp", "subscription", "channel", "geo", "payment_method", "utm_source",
        "subscription_id", "funnel_version", "quiz_version", "split", "upsell_order",
        "upsell_amount", "user_id",
        enrich.present("__view").alias("ups_view"),
        enrich.present("__ttp").alias("ups_ttp"),
        enrich.present("__purch").alias("ups_purched"),
        enrich.flag(F.col("__ifv")).alias("has_insufficient_fund_view"),
        enrich.flag(F.col("__ifc")).alias("has_insufficient_fund_click"),
        F.explode(unsub_values).alias("unsub12h"),
        "purch_count", "purch_amount", "ticket_count",
        enrich.flag(F.col("ticket_count") > 0).alias("is_ticket"),
        "declined_count", "first_declined_at",
        enrich.flag(bought & (F.coalesce(F.col("__ifc"), F.lit(False)) | F.col("__ttp_if")))
        .alias("is_insufficient_fund_purchase"),
        *([enrich.present("__di_user").alias("has_insufficient_funds_decline")]
          if decline_flag else []),
    )
    return out.distinct()


# --- dashboard tables over the pull / user level -------------------------

def upsell_gain(user_df: DataFrame, by=("geo",)) -> DataFrame:
    """Upsell Gain (on View) per slice: mean ``purch_amount`` over viewer rows."""
    viewers = user_df.where(F.col("ups_view") == 1)
    return (viewers.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("viewers"),
                 F.round(exact_sum(F.col("purch_amount")), 6).alias("revenue"),
                 F.round(exact_avg(F.col("purch_amount")), 6).alias("upsell_gain")))


def median_time_to_ttp(app: DataFrame, user_df: DataFrame, by=("geo",)) -> DataFrame:
    """Median seconds from a user's first upsell view to the first purchase click
    of the same upsell slot, per slice (slices from the user-level table)."""
    name = F.col("event_name")
    e = events_named(app, config.UPSELL_VIEW, config.UPSELL_PURCHASE_CLICK)
    e = (J.with_metadata(e, keys=("upsell_order",)).transform(J.with_query_parameters)
         .where((J.meta("source", "qp") == config.REGISTER_SOURCE) & J.meta("upsell_order").isNotNull()))
    t = (e.groupBy("user_id", J.meta("upsell_order").alias("upsell_order"))
         .agg(F.min(F.when(name == config.UPSELL_VIEW, F.col("timestamp"))).alias("__view"),
              F.min(F.when(name == config.UPSELL_PURCHASE_CLICK, F.col("timestamp"))).alias("__ttp"))
         .where(F.col("__ttp") >= F.col("__view"))
         .select("user_id", "upsell_order",
                 F.timestamp_diff("SECOND", F.col("__view"), F.col("__ttp")).alias("secs")))
    slices = user_df.select("user_id", "upsell_order", *by).distinct()
    per = exact_median(t.join(slices, ["user_id", "upsell_order"], "inner"), by, "secs", "median_seconds", "ttp_users")
    return per.withColumn("median_seconds", F.round("median_seconds", 6))


def traffic_composition(pull: DataFrame, by=()) -> DataFrame:
    """Distinct users per subscribe day (and slice) and plan, and the plan's share of the day."""
    per = (pull.groupBy(F.to_date("timestamp").alias("event_date"), *by, "subscription")
           .agg(F.count_distinct("user_id").alias("users")))
    day = Window.partitionBy("event_date", *by)  # a handful of plans per day
    return per.withColumn("share", F.round(F.col("users") / F.sum("users").over(day), 6))


ARM_METRICS = ("rows", "viewers", "ttp_rate", "sr", "upsell_rate", "upsell_gain", "aov")


def arm_comparison(user_df: DataFrame, by=(), control: str | None = None) -> DataFrame:
    """Per arm (and slice): volumes and rates, and the relative change against the
    control arm of the slice: ``control`` (NULL values in a slice without it) or else
    the lexicographically smallest split."""
    by = list(by)
    v, t, p = (F.col(c) == 1 for c in ("ups_view", "ups_ttp", "ups_purched"))
    per = (user_df.where(F.col("split").isNotNull()).groupBy(*by, "split").agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count(F.when(v, 1)).cast("double").alias("viewers"),
        F.avg(F.when(v, F.col("ups_ttp"))).alias("ttp_rate"),
        F.avg(F.when(t, F.col("ups_purched"))).alias("sr"),
        F.avg(F.when(v, F.col("ups_purched"))).alias("upsell_rate"),
        exact_avg(F.when(v, F.col("purch_amount"))).alias("upsell_gain"),
        exact_avg(F.when(p, F.col("purch_amount"))).alias("aov")))
    long = per.unpivot([*by, "split"], list(ARM_METRICS), "metric", "value")
    # the rows here are arms x metrics of each slice; a window keeps NULL slices and reads the pull once
    slice_ = Window.partitionBy(*by, "metric")
    arm = arm_order("split", control)
    out = (long.withColumn("control_split", F.min_by("split", arm).over(slice_))
           .withColumn("control_value", F.min_by("value", arm).over(slice_)))
    if control is not None:
        out = out.withColumns({c: F.when(F.col("control_split") == control, F.col(c))
                               for c in ("control_value", "control_split")})
    rel = F.when(F.col("control_value") != 0,
                 (F.col("value") - F.col("control_value")) / F.col("control_value") * 100)
    return out.select(*by, "split", "metric", F.round("value", 6).alias("value"), "control_split",
                      F.round("control_value", 6).alias("control_value"),
                      F.round(rel, 6).alias("rel_diff_pct"))


def unsub_ratio(pull: DataFrame, by=()) -> DataFrame:
    """Users unsubscribed within 12 h / users with an upsell purchase (one row, or one per slice)."""
    return (pull.groupBy(*by).agg(F.count_distinct(F.when(F.col("unsub12h") == 1, F.col("user_id")))
                     .alias("unsub_users"),
                     F.count_distinct(F.when(F.col("ups_purched") == 1, F.col("user_id")))
                     .alias("purchaser_users"))
            .withColumn("unsub_ratio", F.round(F.when(F.col("purchaser_users") != 0,
                                                     F.col("unsub_users") / F.col("purchaser_users")), 6)))
