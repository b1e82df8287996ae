"""The upsell pull on hand-made rows covering the edge cases in FIXTURES.md §2."""

import datetime as dt
import json

from pyspark.sql import functions as F

from cohortscope.operators import retention as R
from cohortscope.operators import upsell as U

NOW = dt.datetime(2024, 1, 31)
T = dt.datetime(2024, 1, 10, 10, 0, 0)
EVENT = ("event_id string, timestamp timestamp_ntz, user_id string, device_id string, event_name string, "
         "country_code string, ip string, user_agent string, referrer string, event_metadata string, "
         "query_parameters string, event_date date")
PAY = ("customer_account_id string, amount long, created_at long, status string, payment_type string, "
       "rebill_count int, decline_message string")


def _meta(**kw):
    base = {"country_code": "US", "channel": "primer", "card_type": "CREDIT", "subscription": "1Week",
            "payment_method": "card", "utm_source": "google", "funnel_version": "f1", "quiz_version": "q1"}
    base.update(kw)
    return json.dumps({k: v for k, v in base.items() if v is not None})


def _ev(i, ts, user, name, meta="{}", ip="10.0.0.1", source="register"):
    return (f"e{i}", ts, user, f"d{user}", name, "US", ip, None, "https://x/?source=register", meta,
            json.dumps({"source": source}), ts.date())


def _micros(ts):
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def _fixture(spark):
    funnel, app, pay, tickets = [], [], [], []
    i = 0

    def add(rows, *a, **k):
        nonlocal i
        i += 1
        rows.append(_ev(i, *a, **k))

    unsub_at = {"1": T + dt.timedelta(hours=12, minutes=59, seconds=59), "2": T + dt.timedelta(hours=13),
                "3": T - dt.timedelta(hours=1), "4": T + dt.timedelta(hours=1)}
    for u in ["1", "2", "3", "4", "5", "6", "7"]:
        meta = _meta(email=f"{u}@x.com", card_type=None if u == "6" else "CREDIT")
        add(funnel, T, u, "pr_funnel_subscribe", meta)
        add(app, T + dt.timedelta(minutes=1), u, "pr_webapp_registration_signup_click")
        add(app, T + dt.timedelta(minutes=2), u, "pr_webapp_upsell_view",
            json.dumps({"upsell_order": "2", "upsell_version": "u1"}), ip=None if u == "5" else "10.0.0.1")
        if u != "4":
            add(app, T + dt.timedelta(minutes=3), u, "pr_webapp_upsell_purchase_click",
                json.dumps({"upsell_order": "2", "insufficient_fund": "true" if u == "1" else "false"}))
            add(app, T + dt.timedelta(minutes=4), u, "pr_webapp_upsell_successful_purchase",
                json.dumps({"upsell_order": "2", "upsell_amount": "9.99"}))
        if u in unsub_at:
            add(app, unsub_at[u], u, "pr_webapp_unsubscribed")
    settled = {"1": (1000, 1000), "2": (1000, 2000), "3": (1000, 1000), "7": (500, 500)}
    for u, (a20, a22) in settled.items():
        pay.append((u, a20, _micros(T), "settled", "upsell", -20, None))
        pay.append((u, a22, _micros(T), "settled", "upsell", -22, None))
    pay.append(("4", 700, _micros(T), "declined", "upsell", -20, "insufficient funds"))
    tickets.append(("7@x.com", "c1", "Upsell Refund request"))
    return (spark.createDataFrame(funnel, EVENT), spark.createDataFrame(app, EVENT),
            spark.createDataFrame(pay, PAY),
            spark.createDataFrame(tickets, "author_email string, conversation_id string, tag_name string"))


def _pull(spark, **kw):
    f, a, p, t = _fixture(spark)
    return U.upsell_user_level(f, a, p, t, NOW, days=30, **kw)


def test_unsubscribe_window_and_cash_rows(spark):
    rows = _pull(spark).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
    assert set(by_user) == {"1", "2", "3", "4", "7"}          # NULL ip (5) and NULL card type (6) drop
    assert {r.unsub12h for r in by_user["1"]} == {1}           # 12 h 59 min 59 s
    assert {r.unsub12h for r in by_user["2"]} == {0}           # 13 h
    assert {r.unsub12h for r in by_user["3"]} == {1}           # before subscribe
    assert {r.unsub12h for r in by_user["4"]} == {0}           # no purchase
    assert len(by_user["1"]) == 1 and by_user["1"][0].purch_amount == 10.0   # -20/-22 equal: one row
    assert sorted(r.purch_amount for r in by_user["2"]) == [10.0, 20.0]      # unequal: two rows
    assert by_user["1"][0].is_insufficient_fund_purchase == 1
    assert by_user["2"][0].is_insufficient_fund_purchase == 0
    assert by_user["7"][0].ticket_count == 1 and by_user["7"][0].is_ticket == 1
    assert by_user["4"][0].ups_purched == 0 and by_user["4"][0].declined_count is None


def test_flags_keep_non_viewers_and_declines_on_subscriber(spark):
    rows = {r.user_id: r for r in _pull(spark, keep_non_viewers=True).collect()}
    assert rows["5"].ups_view == 0 and rows["5"].split is None
    di = {r.user_id: r.declined_count for r in _pull(spark, declines_on="subscriber").collect()}
    assert di["4"] == 1


def test_first_only_cohort(spark):
    f, _, _, _ = _fixture(spark)
    later = f.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    both = f.unionByName(later.withColumn("event_id", F.concat("event_id", F.lit("b"))))
    assert R.subscription_cohort(both, NOW, 60).count() == 2 * R.subscription_cohort(
        both, NOW, 60, first_only=True).count()


def test_after_purchase_only_drops_earlier_activity(spark):
    entries = spark.createDataFrame([("u", T)], "user_id string, purch_timestamp timestamp_ntz")
    ev = spark.createDataFrame([("u", T - dt.timedelta(hours=2)), ("u", T + dt.timedelta(days=2))],
                               "user_id string, timestamp timestamp_ntz")
    ref = {r.bucket for r in R.bucket_presence(entries, ev).collect()}
    after = {r.bucket for r in R.bucket_presence(entries, ev, after_purchase_only=True).collect()}
    assert ref == {"Day 0", "Day 1"} and after == {"Day 1"}
