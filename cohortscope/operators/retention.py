"""Subscription cohort and retention (lessons and AI tools).

The analysts' query left-joins every cohort row with every lesson event and
every AI event of the user (and with device and path rows), so its row count
is the product of the user's event counts. Here the retention side is
reduced before it meets the cohort: for each cohort entry
``(user_id, purch_timestamp)`` and activity kind, the operator finds which
day buckets contain at least one event, using the as-of operator instead of
pairing entries with events:

bucket ``b`` covers whole-minute differences ``(lo_b, hi_b]``; since the
difference truncates toward zero, an event is in ``b`` iff
``p + (lo_b + 1) min <= ts < p + (hi_b + 1) min``. So ``b`` is present iff
the first event at or after ``p + (lo_b + 1) min`` is before
``p + (hi_b + 1) min``; Day 0 (which also takes events before the purchase)
is present iff the user's first event is before ``p + (hi_0 + 1) min`` (a probe
from the beginning of time).

The matrices turn the probes of all entries into one mask per user and cohort
day (bit b: active in bucket b) and count bits: every matrix, slice and daily
series is an aggregate of ``retention_masks``.

Output grain of ``retention_rows``: one row per (cohort row, activity kind,
bucket) -- the reference's row set up to duplicates, without the
lessons x AI cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope import config
from cohortscope.functions import enrich, json_fields as J
from cohortscope.functions import windows as W
from cohortscope.operators.asof import asof
from cohortscope.operators.identity import user_path
from cohortscope.operators.volume import events_named
from cohortscope.sources.sinks import cut_lineage

COHORT_COLUMNS = ("user_id", "device_id", "purch_date", "personal_plan", "purch_timestamp",
                  "age", "country_code", "gender", "subscription", "channel",
                  "payment_method", "utm_source", "geo")
ACTIVITY_KINDS = {"lessons": config.LESSON_EVENTS, "ai": config.AI_EVENTS}


def subscription_cohort(funnel: DataFrame, now, days: int = 60,
                        first_only: bool = False) -> DataFrame:
    """Distinct subscribe rows with the demographic columns (one JSON parse per row).

    ``first_only`` keeps only each user's earliest subscribe, as the written
    definition of ``purch_date`` says; by default every subscribe is a
    cohort row, as the analysts' query does.
    """
    df = W.last_days(events_named(funnel, config.SUBSCRIBE), days, now)
    df = J.with_metadata(df)
    m = J.meta
    df = (df.where(~m("email").like(config.TEST_EMAIL_LIKE))
          .where(m("country_code") != config.EXCLUDED_COUNTRY))
    out = df.select(
        "user_id", "device_id",
        F.to_date("timestamp").alias("purch_date"),
        m("personal_plan_pk").alias("personal_plan"),
        F.col("timestamp").alias("purch_timestamp"),
        enrich.clean_age(m("age")).alias("age"),
        m("country_code").alias("country_code"),
        enrich.normalize_gender(m("gender")).alias("gender"),
        m("subscription").alias("subscription"),
        m("channel").alias("channel"),
        enrich.normalize_payment_method(m("payment_method")).alias("payment_method"),
        enrich.utm_bucket(m("utm_source")).alias("utm_source"),
        enrich.geo_bucket(m("country_code")).alias("geo"),
    ).distinct()
    if first_only:
        first = out.groupBy("user_id").agg(F.min("purch_timestamp").alias("purch_timestamp"))
        out = out.join(first, ["user_id", "purch_timestamp"], "left_semi")
    return out


def first_event(app: DataFrame, name: str, now, days: int | None = 90,
                prefix: str = "unsub") -> DataFrame:
    """``(<prefix>_user_id, <prefix>_timestamp)``: first occurrence per user."""
    df = W.last_days(events_named(app, name), days, now)
    return (df.groupBy(F.col("user_id").alias(f"{prefix}_user_id"))
            .agg(F.min("timestamp").alias(f"{prefix}_timestamp")))


def activity_named(app: DataFrame, names, now, days: int | None = 90) -> DataFrame:
    return W.last_days(events_named(app, *names), days, now)


def activity(app: DataFrame, names, now, days: int | None = 90) -> DataFrame:
    """``(user_id, timestamp)`` of the listed activity events."""
    return activity_named(app, names, now, days).select("user_id", "timestamp")


def event_users(app: DataFrame, name: str, now, days: int | None = 90,
                open_end: bool = False) -> DataFrame:
    """Distinct users with at least one ``name`` event in the window."""
    win = W.since_days if open_end else W.last_days
    return win(events_named(app, name), days, now).select("user_id").distinct()


def user_profile(app: DataFrame, now, days: int = 90) -> DataFrame:
    """One row per user with an unsubscribe, an iOS or an upsell-purchase event: first
    unsubscribe and the two flags, from one scan (``__user, unsub_timestamp, __ios, __buyer``)."""
    name, today = F.col("event_name"), W.as_date(now)
    # the iOS events have no upper end, the two others end today
    e = W.since_days(events_named(app, config.UNSUBSCRIBED, config.IOS_ACHIEVED, config.UPSELL_PURCHASE), days, now)
    closed = W.day_bounds(e, hi=today)
    return (e.where(F.col("user_id").isNotNull() & ((name == config.IOS_ACHIEVED) | closed))
            .groupBy(F.col("user_id").alias("__user")).agg(
                F.min(F.when(name == config.UNSUBSCRIBED, F.col("timestamp"))).alias("unsub_timestamp"),
                F.max(name == config.IOS_ACHIEVED).alias("__ios"),
                F.max(name == config.UPSELL_PURCHASE).alias("__buyer")))


def registration_device(cohort: DataFrame, app: DataFrame, now, days: int = 90) -> DataFrame:
    """Device profile of registration views at or after one of the user's subscribes.

    "After some cohort row of the user" is ``ts >= min(purch_timestamp)``:
    a one-row-per-user join. User agents are parsed once per distinct
    ``(user, user_agent)``.
    """
    first_purchase = cohort.groupBy("user_id").agg(F.min("purch_timestamp").alias("__p"))
    reg = W.last_days(events_named(app, config.REGISTRATION_VIEW), days, now)
    reg = (reg.join(first_purchase, "user_id", "inner")
           .where(F.col("timestamp") >= F.col("__p"))
           .select("user_id", "user_agent").distinct())
    ua = F.col("user_agent")
    return reg.select(
        F.col("user_id").alias("registration_id"),
        enrich.device_type(ua).alias("reg_device_type"),
        enrich.browser(ua).alias("browser"),
        enrich.operating_system(ua).alias("operating_system"),
        enrich.device_model(ua).alias("device"),
    ).distinct()


def bucket_presence(entries: DataFrame, events: DataFrame, mode: str = "reference",
                    block_seconds: int = 3600, after_purchase_only: bool = False,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """``(user_id, purch_timestamp, *by, bucket)`` for every bucket with an event.

    ``entries``: distinct ``(user_id, purch_timestamp, *by)``; ``events``:
    ``(user_id, *by, timestamp)``, where ``by`` are extra keys both sides share
    (e.g. the activity kind, so several kinds go through one pass). Buckets
    are those of ``enrich.retention_buckets(mode)`` plus the overflow bucket.
    ``after_purchase_only`` drops activity before the purchase (which the
    analysts' query counts as Day 0).
    """
    labels = [b for b, _ in enrich.retention_buckets(mode)] + [config.RETENTION_OVERFLOW]
    found = _bucket_probes(entries.where(F.col("user_id").isNotNull()), events, mode, block_seconds, after_purchase_only, by)
    return found.where("__hit").select("user_id", "purch_timestamp", *by, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("__k") + 1).alias("bucket"))


def _bucket_probes(entries: DataFrame, events: DataFrame, mode: str, block_seconds: int = 3600,
                   after_purchase_only: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Every entry once for each bucket (``__k``; the overflow bucket is the last), with ``__hit``: whether
    the bucket holds an event. Day 0 is probed from the beginning of time (or from the purchase)."""
    ends = [hi for _, hi in enrich.retention_buckets(mode)]
    probes = [F.struct(F.lit(k).alias("__k"), F.lit(lo).cast("int").alias("__lo"), F.lit(hi).cast("int").alias("__hi"))
              for k, (lo, hi) in enumerate(zip([0 if after_purchase_only else None, *[x + 1 for x in ends]], [*[x + 1 for x in ends], None]))]
    p = (entries.select("*", F.explode(F.array(*probes)).alias("__pr")).select(*entries.columns, "__pr.*")
         .withColumn("__t", F.coalesce(F.timestamp_add("MINUTE", F.col("__lo"), F.col("purch_timestamp")), W.ts_lit("0001-01-01 00:00:00"))))
    found = asof(p, events.select("user_id", *by, "timestamp"), ["user_id", *by], "__t", "timestamp", "__next", "forward", block_seconds)
    upper = F.timestamp_add("MINUTE", F.col("__hi"), F.col("purch_timestamp"))
    hit = F.col("__next").isNotNull() & (F.col("__hi").isNull() | (F.col("__next") < upper))
    return found.withColumn("__hit", hit).drop("__next", "__t", "__lo", "__hi")


def retention_masks(funnel: DataFrame, app: DataFrame, now, kind: str = "lessons", cohort_days: int = 60,
                    activity_days: int = 90, mode: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """``(purch_date, *by, user_id, mask)``: bit k of ``mask`` says that the user was active in bucket k
    of one of the day's subscriptions. Every matrix and slice is an aggregate of these rows.

    The cohort and the activity are read once each.
    """
    entries = (subscription_cohort(funnel, now, cohort_days)
               .select("user_id", "purch_timestamp", "purch_date", *by).distinct())
    found = _bucket_probes(entries, activity(app, ACTIVITY_KINDS[kind], now, activity_days), mode)
    bit = F.when(F.col("__hit"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k"))).otherwise(F.lit(0).cast("long"))
    return found.groupBy("purch_date", *by, "user_id").agg(F.bit_or(bit).alias("mask"))


def _bucket_counts(masks: DataFrame, n: int, by) -> DataFrame:
    """Users of each day's cohort (slice), and how many of them have each bit."""
    has = [F.call_function("getbit", F.col("mask"), F.lit(k)).cast("long") for k in range(n)]
    known = F.col("user_id").isNotNull()
    return masks.groupBy("purch_date", *by).agg(
        F.count("user_id").alias("cohort_users"), *[F.sum(F.when(known, x)).alias(f"__d{k}") for k, x in enumerate(has)])


def _presence_by_kind(cohort: DataFrame, app: DataFrame, now, days: int, mode: str,
                      kinds=ACTIVITY_KINDS) -> DataFrame:
    """Bucket presence for every activity kind in one as-of pass (kind is a key)."""
    kind_of = None
    for kind, names in kinds.items():
        cond = F.col("event_name").isin(*names)
        kind_of = F.when(cond, F.lit(kind)) if kind_of is None else kind_of.when(cond, F.lit(kind))
    all_names = [n for names in kinds.values() for n in names]
    events = (activity_named(app, all_names, now, days)
              .select("user_id", kind_of.alias("activity"), "timestamp"))
    entries = (cohort.select("user_id", "purch_timestamp").distinct()
               .withColumn("activity", F.explode(F.array(*[F.lit(k) for k in kinds]))))
    return bucket_presence(entries, events, mode, by=("activity",))


def retention_rows(funnel: DataFrame, app: DataFrame, now, cohort_days: int = 60,
                   activity_days: int = 90, path_days: int = 180,
                   mode: str = "reference") -> DataFrame:
    """Cohort rows enriched with path, unsubscribe, platform, device, upsell flag,
    and one row per activity kind and retention bucket.

    A cohort row without activity of a kind gets one ``'> 30'`` row with a
    NULL ``ret_user_id`` (the analysts' ELSE branch for a NULL difference).
    """
    # the cohort feeds five branches (entries, device and path resolution,
    # registration, the final rows): checkpoint it once into the shared
    # folder instead of rescanning the subscribe events in each branch
    cohort = cut_lineage(subscription_cohort(funnel, now, cohort_days))
    presence = _presence_by_kind(cohort, app, now, activity_days, mode)
    kinds = F.array(*[F.lit(k) for k in ACTIVITY_KINDS])
    # rows without a user match nothing: a key of their own spreads them over all tasks
    nobody = F.concat(F.lit("\0"), F.xxhash64(*COHORT_COLUMNS).cast("string"))
    per_kind = cohort.select(*COHORT_COLUMNS, F.coalesce("user_id", nobody).alias("__key"),
                             F.explode(kinds).alias("activity"))
    buckets = (per_kind.join(presence.withColumnRenamed("user_id", "__key"),
                             ["__key", "purch_timestamp", "activity"], "left")
               .select(*COHORT_COLUMNS, "__key", "activity",
                       F.when(F.col("bucket").isNotNull(), F.col("user_id")).alias("ret_user_id"),
                       F.coalesce("bucket", F.lit(config.RETENTION_OVERFLOW)).alias("retention_day")))
    profile = (user_profile(app, now, activity_days)
               .join(registration_device(cohort, app, now, activity_days)
                     .withColumnRenamed("registration_id", "__user"), "__user", "full")
               .join(user_path(funnel, cohort, now, path_days, cohort_days)
                     .withColumnRenamed("user_id", "__user"), "__user", "full"))
    out = buckets.join(profile, F.col("__key") == F.col("__user"), "left")
    # every side is distinct on its own: the cohort and its buckets, and the users' profiles
    return out.select(
        *COHORT_COLUMNS, "user_path", F.when(F.col("unsub_timestamp").isNotNull(), F.col("__user")).alias("unsub_user_id"),
        "unsub_timestamp", F.when(F.col("__ios"), F.lit("app")).otherwise(F.lit("web")).alias("web_app"),
        "activity", "ret_user_id", "retention_day",
        "device", "reg_device_type", "operating_system", "browser",
        enrich.flag(F.col("__buyer")).alias("purchased_upsell"))


def retention_matrix(funnel: DataFrame, app: DataFrame, now, kind: str = "lessons",
                     cohort_days: int = 60, activity_days: int = 90,
                     mode: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of each subscribe-date cohort active in each day bucket (wide).

    ``cohort_users``: distinct users subscribing that day; ``retention_dN``:
    distinct of them with ``kind`` activity in bucket N, divided by
    ``cohort_users``. ``by`` adds cohort columns (geo, subscription, ...).
    """
    labels = [b for b, _ in enrich.retention_buckets(mode)]
    counts = _bucket_counts(retention_masks(funnel, app, now, kind, cohort_days, activity_days, mode, by), len(labels), by)
    cols = [F.round(F.try_divide(F.coalesce(f"__d{k}", F.lit(0)), F.col("cohort_users")), 6)
            .alias("retention_d" + b.split()[-1]) for k, b in enumerate(labels)]
    return counts.select(F.col("purch_date").alias("cohort_date"), *by, "cohort_users", *cols)


def retention_daily(funnel: DataFrame, app: DataFrame, now, kind: str = "lessons",
                    cohort_days: int = 60, activity_days: int = 90,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Long form with one bucket per day (0..30): ``(cohort_date, *by, day, active_users,
    cohort_users, rate)``."""
    labels = [b for b, _ in enrich.retention_buckets("daily")]
    counts = _bucket_counts(retention_masks(funnel, app, now, kind, cohort_days, activity_days, "daily", by), len(labels), by)
    days = F.array(*[F.struct(F.lit(int(b.split()[-1])).alias("day"), F.col(f"__d{k}").alias("active_users")) for k, b in enumerate(labels)])
    return (counts.select(F.col("purch_date").alias("cohort_date"), *by, "cohort_users", F.inline(days))
            .where(F.col("active_users") > 0)
            .select("cohort_date", *by, "day", "active_users", "cohort_users",
                    F.round(F.col("active_users") / F.col("cohort_users"), 6).alias("rate")))


def early_unsubscribes(funnel: DataFrame, app: DataFrame, now, days: int = 60, hours: int = 12,
                       by: tuple[str, ...] = ("geo",)) -> DataFrame:
    """Subscribers and those of them who unsubscribed within ``hours`` of a subscribe, per slice:
    the churn rate as it is defined in writing, whatever the user bought."""
    entries = (subscription_cohort(funnel, now, days).where(F.col("user_id").isNotNull())
               .select("user_id", "purch_timestamp", *by).distinct())
    unsubs = W.since_days(events_named(app, config.UNSUBSCRIBED), days, now).select("user_id", "timestamp")
    found = asof(entries, unsubs, ["user_id"], "purch_timestamp", "timestamp", "__unsub")
    soon = F.coalesce(F.col("__unsub") <= F.timestamp_add("HOUR", F.lit(hours), F.col("purch_timestamp")), F.lit(False))
    per_user = found.groupBy(*by, "user_id").agg(F.max(soon).alias("__soon"))
    return (per_user.groupBy(*by).agg(F.count(F.lit(1)).alias("subscribers"), F.count_if("__soon").alias("unsubscribed"))
            .withColumn("unsub_share", F.round(F.col("unsubscribed") / F.col("subscribers"), 6)))
