"""The queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontamination, embeddings, language, licenses, mixing, near_duplicates, oracles, pii, sharding, suffix_tree, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    added = [pii.count(F.col("spans"), pii.SECRET).alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), *added)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 4, 2))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", covered("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("repeated").alias("n_repeated"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is a directory, with one for every thousand documents below it
    name = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = licenses.scan(_table(spark, sf_dir, "documents").withColumn("path", name), carry=("doc_id",))
    return found.select("doc_id", "path", "license", "score", "origin", "from_dir", F.array_join("notices", ",").alias("notices"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(_table(spark, sf_dir, "embeddings"))


def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id", 7, 2))
    return suffix_tree.score(docs, ~F.col("held_out"), carry=("held_out",))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    mix = mixing.mix(_table(spark, sf_dir, "documents"), labels)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {f.__name__: f for f in (op1_decontamination, op2_pii, op3_near_duplicates, op4_sharding, op5_language, op6_suffix_dedup, op7_licenses, op8_embeddings, op9_scoring, op10_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    found = {"op1_decontamination": oracles.DECONTAMINATION, "op3_near_duplicates": oracles.NEAR_DUPLICATES, "op8_embeddings": oracles.EMBEDDINGS}
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
