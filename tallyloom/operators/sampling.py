"""Seeded sampling by hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.order import placed_in_groups, positioned


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that follows from the columns and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def epochs(spark: SparkSession, ids: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Every id once in each epoch, with its place in that epoch's shuffle."""
    each = ids.select(key).distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = placed_in_groups(each, ["epoch"], [uniform(seed, key, "epoch"), F.col(key)])
    return placed.select(*each.columns, (F.col("pos") + 1).cast("int").alias("place"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds place, from 0, in a permutation of the rows that follows from key and seed."""
    return positioned(df, [uniform(seed, key), F.col(key)]).drop("total").withColumnRenamed("pos", "place")


def small_split(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` different keys (all if there are fewer) in a shuffled order, with their place and whether fewer were there."""
    placed = positioned(df.select(key).distinct(), [uniform(seed, key), F.col(key)])
    return placed.filter(F.col("pos") < size).select(key, F.col("pos").alias("place"), (F.col("total") < size).alias("short"))


def mixture(df: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Adds sampler, drawn with the given shares, which must sum to 1."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    u, upto, chosen = uniform(seed, key), 0.0, None
    for name, share in shares.items():
        upto += share
        chosen = F.when(u < upto, name) if chosen is None else chosen.when(u < upto, name)
    return df.withColumn("sampler", chosen.otherwise(list(shares)[-1]))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def per_group(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, drawn by hash."""
    w = Window.partitionBy(by).orderBy(uniform(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def bernoulli(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return df.filter(uniform(seed, key) < share)
