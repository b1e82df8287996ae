"""Readers for the production layout of the product's tables.

Event logs are parquet datasets partitioned by ``event_date``; the readers
apply the date bounds to the partition column so only the needed directories
are listed and scanned. All schemas are explicit (no inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.functions.windows import as_date, micros_to_ts

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("attribution_id", T.StringType()),
    T.StructField("event_metadata", T.StringType()),
    T.StructField("query_parameters", T.StringType()),
    T.StructField("user_metadata", T.StringType()),
    T.StructField("event_date", T.DateType()),
])

PAYMENT_SCHEMA = T.StructType([
    T.StructField("customer_account_id", T.StringType()),
    T.StructField("amount", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("rebill_count", T.IntegerType()),
    T.StructField("decline_message", T.StringType()),
])

TICKET_SCHEMA = T.StructType([
    T.StructField("author_email", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("tag_name", T.StringType()),
])

UPSELL_PULL_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("subscription", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("geo", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("utm_source", T.StringType()),
    T.StructField("subscription_id", T.StringType()),
    T.StructField("funnel_version", T.StringType()),
    T.StructField("quiz_version", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("upsell_order", T.StringType()),
    T.StructField("upsell_amount", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ups_view", T.IntegerType()),
    T.StructField("ups_ttp", T.IntegerType()),
    T.StructField("ups_purched", T.IntegerType()),
    T.StructField("has_insufficient_fund_view", T.IntegerType()),
    T.StructField("has_insufficient_fund_click", T.IntegerType()),
    T.StructField("unsub12h", T.IntegerType()),
    T.StructField("purch_count", T.LongType()),
    T.StructField("purch_amount", T.DoubleType()),
    T.StructField("ticket_count", T.LongType()),
    T.StructField("is_ticket", T.IntegerType()),
    T.StructField("declined_count", T.LongType()),
    T.StructField("first_declined_at", T.TimestampNTZType()),
    T.StructField("is_insufficient_fund_purchase", T.IntegerType()),
    T.StructField("ltv", T.DoubleType()),
])


def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Scan an event table; ``start``/``end`` (dates) prune ``event_date`` partitions."""
    df = spark.read.schema(EVENT_SCHEMA).parquet(path)
    if start is not None:
        df = df.where(F.col("event_date") >= F.lit(as_date(start)))
    if end is not None:
        df = df.where(F.col("event_date") <= F.lit(as_date(end)))
    return df


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """Payments with ``created_ts`` (NTZ) derived from epoch microseconds."""
    return (spark.read.schema(PAYMENT_SCHEMA).parquet(path)
            .withColumn("created_ts", micros_to_ts("created_at")))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICKET_SCHEMA).parquet(path)


def read_upsell_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported user pull as CSV with a header; schema fixed, never inferred."""
    return (spark.read.schema(UPSELL_PULL_SCHEMA)
            .option("header", True).option("mode", "FAILFAST").csv(path))
