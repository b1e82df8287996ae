"""The thin queries over the driver's tables: each runs one operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, convtrie, divergence, langid, linkgraph, lm, neardup, pii, quality, secretscan, tiling, tokenfile, toxicity
from .common import documents, held_out


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prototypes = langid.train(docs, ~held_out("doc_id", 3, 1))
    return langid.predict(docs, prototypes).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "cosine")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~held_out("doc_id", 3, 1))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "exact", "misspelled")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), _vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir), ~held_out("doc_id", 7, 2))
    return scored.withColumn("held_out", held_out("doc_id", 7, 2))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.checked(spark, documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_minhash_neardup, op2_language_id, op3_toxicity, op4_bpe_round_trip, op5_pii, op6_lm_score,
    op7_decontamination, op8_quality, op9_secrets, op10_token_files,
    op11_source_divergence, op12_prefix_trie, op13_url_filter, pipeline)}
SQL: dict[str, str] = {"op11_source_divergence": divergence.SQL, "op12_prefix_trie": convtrie.SQL, "op13_url_filter": linkgraph.SQL}
