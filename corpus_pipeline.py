"""A corpus from documents in five stages: language, near-duplicates, benchmarks, mixture, shards.

Each stage takes (spark, docs, sf_dir) with docs read from Parquet and returns a frame to be written
before the next stage begins, for a stage first deletes what earlier ones left in the shared folder.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom import storage
from tallyloom.llm import decontamination, language, mixing, near_duplicates, sharding
from tallyloom.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose clearest language has a smaller share of its words is rejected.
LEAST_SHARE = 0.4


def _stage(f):
    """A stage that first deletes what earlier stages left in the shared folder, but no other run's tables."""

    @wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.release(spark, "pipeline")
        with storage.run("pipeline"):
            return f(spark, docs, sf_dir)

    return run_


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which ``LEAST_SHARE`` of the words are in one language; lang becomes that."""
    model = language.fit(docs)
    found = language.predict(docs, model, carry=("text", "source", "n_chars")).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return found.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return near_duplicates.classes(docs, carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.matches(docs, benchmark, carry=COLUMNS[1:]).filter("n_hit = 0").select(*COLUMNS)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text", "source").alias("_h")]
    keyed = docs.select("*", *key)
    taken = mixing.mix(keyed, labels, carry=("_id", "_h")).select("_id", "_h", "times")
    # rows alike in id, text and source are interchangeable: number them on both sides
    nth = lambda order: F.row_number().over(Window.partitionBy("_id", "_h").orderBy(order))
    taken = taken.withColumn("_k", nth("times"))
    joined = keyed.withColumn("_k", nth("n_chars")).join(taken, ["_id", "_h", "_k"]).filter("times > 0")
    return joined.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*COLUMNS)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mixture."""
    return sharding.shards(docs)


STAGES = [("language", identify), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: SQL can't express the language model or the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
