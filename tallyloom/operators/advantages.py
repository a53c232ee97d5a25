"""Group-relative advantages, threshold and top-k filters, and even splits among workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.order import parted, placed_in_groups, positioned

BASELINES = ("leave_one_out", "leave_none_out")


def advantages(df: DataFrame, group: list[str], ret: str = "ret", baseline: str = "leave_one_out", normalise: bool = False) -> DataFrame:
    """Adds n, baseline and advantage.  Groups of one row are left out: they have no leave-one-out baseline.

    One partial aggregate per group joined back, so a huge group costs no window in one task.
    """
    if baseline not in BASELINES:
        raise ValueError(f"baseline must be one of {BASELINES}")
    stats = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(ret).alias("_s"), F.stddev_pop(ret).alias("_d")).filter("n >= 2")
    joined = df.join(stats, group)
    mean = (F.col("_s") - F.col(ret)) / (F.col("n") - 1) if baseline == "leave_one_out" else F.col("_s") / F.col("n")
    value: Column = F.col(ret) - mean
    if normalise:
        value = value / F.greatest(F.col("_d"), F.lit(1e-7))
    return joined.select(*df.columns, "n", mean.alias("baseline"), value.alias("advantage"))


def keep_count(df: DataFrame, threshold: float, world: int, positive_only: bool = False) -> DataFrame:
    """One row: total, above (at the threshold), keep: above rounded up to a multiple of ``world``, one at
    least and no more than there are."""
    size = F.round(F.col("advantage") if positive_only else F.abs("advantage"), 9)  # sums in any order agree
    counted = df.agg(F.count("*").alias("total"), F.count_if(size >= threshold).alias("above"))
    wanted = F.greatest(F.ceil(F.col("above") / world), F.lit(1))
    return counted.withColumn("keep", (F.least(wanted, F.floor(F.col("total") / world)) * world).cast("long"))


def ranked(df: DataFrame, key: str, threshold: float = 0.01, world: int = 1, positive_only: bool = False) -> DataFrame:
    """Adds pos, the place by size (ties by key), and the columns of ``keep_count``; rows are sorted by range and written."""
    size = F.round(F.col("advantage") if positive_only else F.abs("advantage"), 9)
    placed = positioned(df.withColumn("_size", size), [F.col("_size").desc(), F.col(key)]).drop("total")
    return placed.crossJoin(F.broadcast(keep_count(placed, threshold, world, positive_only)))


def top_advantages(df: DataFrame, key: str, threshold: float = 0.01, world: int = 1, positive_only: bool = False) -> DataFrame:
    """The ``keep`` rows of largest size, ties by key; they stay spread over the partitions."""
    return ranked(df, key, threshold, world, positive_only).filter("pos < keep").select(*df.columns)


def filter_stats(df: DataFrame, key: str, threshold: float = 0.01, world: int = 1) -> DataFrame:
    """Share of rows dropped and the largest size among them (0 if none is)."""
    found = ranked(df, key, threshold, world).agg(F.max("total").alias("total"), F.max("keep").alias("keep"), F.coalesce(F.max(F.when(F.col("pos") >= F.col("keep"), F.col("_size"))), F.lit(0.0)).alias("empirical_threshold"))
    return found.select("total", "keep", (1 - F.col("keep") / F.col("total")).alias("filtered"), "empirical_threshold")


def split_evenly(df: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Adds worker: contiguous parts of equal size, the first ones one longer if need be."""
    placed = positioned(df, [F.col(c) for c in order])
    return placed.select(*df.columns, parted(F.col("pos"), F.col("total"), workers).alias("worker"))


def minibatches(df: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Adds batch within each ``by``; the last may be short."""
    placed = placed_in_groups(df, [by], [F.col(c) for c in order])
    return placed.select(*df.columns, F.floor(F.col("pos") / size).cast("long").alias("batch"))
