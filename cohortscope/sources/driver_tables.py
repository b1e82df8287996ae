"""Adapter: the generated test tables -> the product's data model.

The test data ships generic tables (``events``, ``orders``, ``conversations``)
rather than the product's event log. This module derives the four source
tables the operators read (``funnel_raw``, ``app_raw``, ``payments``,
``tickets``) from them with projections only -- no joins, no shuffles -- so
each derived table scales linearly with its input and keeps the scan's
filter pushdown on ``ts``.

The select lists are plain SQL expressions. Spark applies them with
``selectExpr`` on DataFrames (no temp views, no catalog side effects); the
DuckDB oracle repeats the same text as CTEs (``oracle_ctes``), so both
engines read identical inputs. ``{K}`` and ``{TS}`` are the only dialect
differences.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortscope.sources.events import read_events, read_payments, read_tickets

_K = {
    "spark": "cast(get_json_object(props, '$.k') as int)",
    "duckdb": "cast(json_extract_string(props, '$.k') as int)",
}
_TS = {"spark": "`timestamp`", "duckdb": '"timestamp"'}

BASE_SELECT = [
    "event_id", "ts", "user_id", "event_type", "{K} as k",
    "case user_id % 6 when 0 then 'US' when 1 then 'DE' when 2 then 'KZ' "
    "when 3 then 'BR' when 4 then 'JP' else 'IN' end as cc",
]

FUNNEL_TYPES = "event_type in ('view', 'click', 'signup')"
FUNNEL_SELECT = [
    "cast(event_id as string) as event_id",
    "ts as {TS}",
    "case when event_type = 'view' and k % 10 = 0 then null "
    "when event_type = 'view' and k % 10 = 5 then 'undefined' "
    "else cast(user_id as string) end as user_id",
    "'d' || cast(user_id - case when user_id % 20 = 1 then 1 else 0 end as string) as device_id",
    "case event_type when 'click' then 'pr_funnel_email_submit' "
    "when 'signup' then 'pr_funnel_subscribe' else "
    "case k % 4 when 0 then 'pr_funnel_scale_path' when 1 then 'pr_funnel_escape_path' "
    "when 2 then 'pr_funnel_simplify_path' else 'pr_funnel_starter_path' end end as event_name",
    "case when k % 29 = 0 then null else cc end as country_code",
    """'{"country_code":"' || cc || '","channel":"' || case when k % 10 = 0 then 'paypal' else 'primer' end"""
    """ || '","subscription":"' || case k % 3 when 0 then '1Week' when 1 then '4Week' else '12Week' end"""
    """ || '","payment_method":"' || case k % 4 when 0 then 'apple_pay' when 1 then 'applepay' else 'card' end"""
    """ || '","utm_source":"' || case k % 5 when 0 then 'fb_bio' when 1 then 'TikTok' when 2 then 'google'"""
    """ when 3 then 'unionapps' else 'mail' end"""
    """ || '","gender":"' || case k % 5 when 0 then 'Mujer' when 1 then 'female' when 2 then 'Male'"""
    """ when 3 then 'Hombre' else '' end"""
    """ || '","age":"' || case when k % 6 = 0 then '' else '25-34' end"""
    """ || '","funnel_version":"f' || cast(k % 3 as string) || '","quiz_version":"q' || cast(k % 2 as string)"""
    """ || '","card_type":"' || case when k % 12 = 0 then 'PREPAID' else 'CREDIT' end || '"'"""
    """ || case when k % 31 = 0 then '' else ',"email":"' || case when user_id % 25 = 0 then 'test' else 'user' end"""
    """ || cast(user_id as string) || '@example.com"' end"""
    """ || case when k % 4 = 0 then ',"scale_path":"scale_path"' when k % 4 = 1 then ',"starter_path":"starter_path"'"""
    """ else '' end || '}' as event_metadata""",
]

APP_TYPES = "event_type in ('purchase', 'error')"
APP_SELECT = [
    "cast(event_id as string) as event_id",
    "ts as {TS}",
    "cast(user_id as string) as user_id",
    "case when event_type = 'purchase' then case k % 5 when 0 then 'pr_webapp_registration_signup_click' "
    "when 1 then 'pr_webapp_registration_view' when 2 then 'pr_webapp_upsell_view' "
    "when 3 then 'pr_webapp_upsell_purchase_click' else 'pr_webapp_upsell_successful_purchase' end "
    "else case k % 8 when 0 then 'pr_webapp_lesson_started' when 1 then 'pr_webapp_lesson_completed' "
    "when 2 then 'pr_webapp_ai_chat_message_sent' when 3 then 'pr_webapp_ai_assistant_generate_click' "
    "when 4 then 'pr_webapp_unsubscribed' when 5 then 'pr_webapp_upsell_insufficient_fund_view' "
    "when 6 then 'pr_webapp_upsell_insufficient_fund_click' else 'pr_webapp_ios_succesfully_achieved' end end "
    "as event_name",
    "case when k % 17 = 0 then null when k % 13 = 0 then '45.8.117.97' else '10.0.0.1' end as ip",
    "case user_id % 7 "
    "when 0 then 'Mozilla/5.0 (iPhone; iPhone17,1; CPU iPhone OS 18_0 like Mac OS X) Safari/604.1' "
    "when 1 then 'Mozilla/5.0 (Linux; Android 15; SM-S931B) Chrome/130.0 Mobile Safari/537.36' "
    "when 2 then 'Mozilla/5.0 (Linux; Android 15; Pixel 9 Pro) Chrome/130.0 Mobile Safari/537.36' "
    "when 3 then 'Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/130.0 Safari/537.36 Edg/130.0' "
    "when 4 then 'Mozilla/5.0 (Windows NT 10.0) Chrome/130.0 Safari/537.36 OPR/115.0' "
    "when 5 then 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Version/17.0 Safari/605.1' "
    "else null end as user_agent",
    "'https://app.example.com/?source=register' || case when k >= 50 then '&upsell_version=' || "
    "case user_id % 2 when 0 then 'u15.3.1' else 'u15.4.1' end || '&z=1' else '' end as referrer",
    """'{"upsell_order":"' || case when k % 2 = 0 then '1' else '2' end || '","upsell_amount":"19.99"'"""
    """ || case when k < 50 and k % 7 <> 0 then ',"upsell_version":"' || case user_id % 2 when 0 then 'u15.3.1'"""
    """ else 'u15.4.1' end || '"' else '' end"""
    """ || case when k % 11 = 0 then ',"insufficient_fund":"true"' else '' end || '}' as event_metadata""",
    """'{"source":"' || case when k % 9 = 0 then 'profile' else 'register' end || '"}' as query_parameters""",
]

PAYMENTS_SELECT = [
    "cast(o_custkey as string) as customer_account_id",
    "cast(round(o_totalprice * 100) as bigint) as amount",
    "1704067200000000 + (o_orderkey % 30) * 86400000000 as created_at",
    "case o_orderstatus when 'F' then 'settled' when 'P' then 'declined' else 'pending' end as status",
    "case when o_orderkey % 2 = 0 then 'upsell' else 'subscription' end as payment_type",
    "case o_orderkey % 3 when 0 then -14 when 1 then -20 else -22 end as rebill_count",
    "case o_orderpriority when '1-URGENT' then 'Insufficient Funds' when '2-HIGH' then 'INSUFFICIENT FUNDS' "
    "else 'Do not honor' end as decline_message",
]

TICKETS_SELECT = [
    "'user' || cast(conv_id as string) || '@example.com' as author_email",
    "cast(conv_id * 1000 + turn as string) as conversation_id",
    "case when turn % 3 = 0 then 'Upsell Refund request' else 'other' end as tag_name",
]


def _render(items: list[str], dialect: str) -> list[str]:
    return [i.replace("{K}", _K[dialect]).replace("{TS}", _TS[dialect]) for i in items]


@dataclass(frozen=True)
class Sources:
    """The product's source tables as DataFrames."""

    funnel: DataFrame
    app: DataFrame
    payments: DataFrame
    tickets: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str) -> Sources:
    """The source tables as lazy projections of the generated tables."""
    events = _read(spark, sf_dir, "events")
    base = events.selectExpr(*_render(BASE_SELECT, "spark"))
    funnel = (base.where(FUNNEL_TYPES).selectExpr(*_render(FUNNEL_SELECT, "spark"))
              .selectExpr("*", "to_date(`timestamp`) as event_date"))
    app = (base.where(APP_TYPES).selectExpr(*_render(APP_SELECT, "spark"))
           .selectExpr("*", "to_date(`timestamp`) as event_date"))
    payments = _read(spark, sf_dir, "orders").selectExpr(*_render(PAYMENTS_SELECT, "spark"))
    tickets = _read(spark, sf_dir, "conversations").selectExpr(*_render(TICKETS_SELECT, "spark"))
    return Sources(funnel=funnel, app=app, payments=payments, tickets=tickets)


_INPUTS = ("events", "orders", "conversations")
LAYOUT_VERSION = 2  # bump when the stored layout or marker format changes
_LOADED: dict[tuple, Sources] = {}
_LOCK = threading.Lock()


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Input files with sizes and modification times, as the Hadoop file system lists them, plus the adapter text itself."""
    h = hashlib.sha1()
    h.update(f"layout-{LAYOUT_VERSION}:{sf_dir.rstrip('/')}".encode())
    jvm = spark.sparkContext._jvm
    for name in _INPUTS:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
        h.update(f"{name}:{sorted(found)}".encode())
    for items in (BASE_SELECT, FUNNEL_SELECT, APP_SELECT, PAYMENTS_SELECT, TICKETS_SELECT):
        h.update("\x1f".join(items).encode())
    return h.hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _write_event_table(df: DataFrame, path: str, partitions: int) -> None:
    # production layout: one directory per day, rows clustered by event name
    # so name filters skip row groups; range partitioning keeps a busy day
    # from landing in one task
    (df.repartitionByRange(partitions, "event_date", "event_name", "user_id")
     .sortWithinPartitions("event_date", "event_name", "user_id")
     .write.mode("overwrite").partitionBy("event_date").parquet(path))


def materialize(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write the derived tables once under ``root`` (a shared folder); return their path.

    Each build goes to its own versioned directory and the ``_READY`` marker
    (naming that directory) is written last, so a concurrent reader only ever
    sees a complete build.
    """
    base = f"{root.rstrip('/')}/cohortscope_sources/{_fingerprint(spark, sf_dir)}"
    ready = f"{base}/_READY"
    if _exists(spark, ready):
        return spark.read.json(ready).first()["path"]
    data = f"{base}/v-{uuid.uuid4().hex[:12]}"
    s = derive(spark, sf_dir)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    _write_event_table(s.funnel, f"{data}/funnel", parts)
    _write_event_table(s.app, f"{data}/app", parts)
    s.payments.write.mode("overwrite").parquet(f"{data}/payments")
    s.tickets.write.mode("overwrite").parquet(f"{data}/tickets")
    (spark.createDataFrame([(data, sf_dir)], "path string, source string")
     .coalesce(1).write.mode("overwrite").json(ready))
    return data


def load(spark: SparkSession, sf_dir: str, materialized: bool | None = None) -> Sources:
    """Source tables for ``sf_dir``.

    With a shared ``spark.checkpoint.dir`` the derived tables are written
    there once (keyed by a fingerprint of the inputs and of this adapter) in
    the production layout -- event tables partitioned by ``event_date`` and
    clustered by ``event_name`` -- and read back, so queries get partition
    pruning and row-group skipping as on the real tables. Without one (or
    with ``COHORTSCOPE_MATERIALIZE=0``), the lazy projections are returned.
    """
    # frames live as long as their application; inputs that change are read anew
    key = (spark.sparkContext.applicationId, sf_dir.rstrip('/'), materialized, os.environ.get("COHORTSCOPE_MATERIALIZE"), _fingerprint(spark, sf_dir))
    with _LOCK:
        if key not in _LOADED:
            _LOADED[key] = _load(spark, sf_dir, materialized)
        return _LOADED[key]


def _load(spark: SparkSession, sf_dir: str, materialized: bool | None) -> Sources:
    if materialized is None and os.environ.get("COHORTSCOPE_MATERIALIZE") in ("0", "false"):
        materialized = False
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if materialized is False or (materialized is None and not root):
        out = derive(spark, sf_dir)
    else:
        base = materialize(spark, sf_dir, root)
        out = Sources(
            funnel=read_events(spark, f"{base}/funnel"),
            app=read_events(spark, f"{base}/app"),
            payments=read_payments(spark, f"{base}/payments"),
            tickets=read_tickets(spark, f"{base}/tickets"),
        )
    return out


def oracle_ctes() -> str:
    """``WITH`` prefix defining funnel_raw, app_raw, payments_raw, tickets_raw in DuckDB."""
    d = "duckdb"
    base = "select " + ", ".join(_render(BASE_SELECT, d)) + " from events"
    funnel = "select " + ", ".join(_render(FUNNEL_SELECT, d)) + f" from b where {FUNNEL_TYPES}"
    app = "select " + ", ".join(_render(APP_SELECT, d)) + f" from b where {APP_TYPES}"
    pay = "select " + ", ".join(_render(PAYMENTS_SELECT, d)) + " from orders"
    tick = "select " + ", ".join(_render(TICKETS_SELECT, d)) + " from conversations"
    return (f"WITH b AS ({base}),\nfunnel_raw AS ({funnel}),\napp_raw AS ({app}),\n"
            f"payments_raw AS ({pay}),\ntickets_raw AS ({tick})")
