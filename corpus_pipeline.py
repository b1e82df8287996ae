"""Corpus cleaning: language, near copies, benchmark passages, secrets, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of documents. Decisions:

* language: learned from the rows that carry a language; texts without a
  letter or far from every language go;
* near copies: one document of each group stays, the one with the least id;
* decontamination: documents that hold most of a benchmark item go;
* secrets: spans are replaced by ``[SECRET]``;
* tokens: ids and their decoding, as digests, one row per document kept.

Null texts go in the first stage; empty tables pass through; further columns
are carried along up to the last stage. The stages hand texts to the Python
workers in batches of at most ``BATCH_ROWS`` rows. Their results are computed
only when they are written, so this session setting holds from the first stage
called to the end of the last, which is computed at once and restores it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm import bpe, langid, neardup, secretscan, tiling
from cohortscope.llm.common import documents, stored

#: Rows of an Arrow batch. A worker and its JVM hold batches whole, twice while the next one comes; results do not depend on it.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BEFORE = "cohortscope.pipeline.maxRecordsBefore"


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in a batch until ``own_batches``; a smaller setting stays."""
    if spark.conf.get(_BEFORE, None) is None:
        before = spark.conf.get(_BATCH, None)
        spark.conf.set(_BEFORE, before or "")
        if not 0 < int(before or 0) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))


def own_batches(spark: SparkSession) -> None:
    """Batches as the session had them before ``small_batches``."""
    before = spark.conf.get(_BEFORE, None)
    if before is not None:
        spark.conf.unset(_BEFORE)
        spark.conf.set(_BATCH, before) if before else spark.conf.unset(_BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs, langid.train(docs, F.lit(True)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secretscan.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    try:
        return stored(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), "token_ids")
    finally:
        own_batches(spark)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("token_ids", token_ids),
]
#: No SQL expresses signatures, tilings or byte-pair merges; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    try:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        own_batches(spark)
