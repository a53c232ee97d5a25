"""Places in a sorted frame without one task that sees all rows: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.storage import materialise

#: monotonically_increasing_id holds the partition above these bits and the row within it below.
_BITS = 33


def positioned(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with pos, the rows before each one in ``order``, and total, the number of all rows.

    Rows are dealt out by range, sorted in each partition and written once, so that the numbers stay the
    same; then the counts of the partitions, as many rows as there are partitions, give each its start.  An
    empty frame gives none.  ``order`` should be unique, else rows that tie get their places in no set order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    written = materialise(dealt, "ordered").withColumn("_part", F.shiftright("_id", _BITS))
    counts = written.groupBy("_part").agg(F.count("*").alias("_n"))
    by_part = Window.orderBy("_part")
    starts = counts.select("_part", (F.sum("_n").over(by_part) - F.col("_n")).alias("_start"), F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    pos = F.col("_id") - F.shiftleft("_part", _BITS) + F.col("_start")
    return written.join(F.broadcast(starts), "_part").select(*df.columns, pos.alias("pos"), "total")


def placed_in_groups(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with pos, the rows of the same group before each one in ``order``; a group may lie in many partitions."""
    rows = positioned(df, [*(F.col(c) for c in by), *order]).drop("total").withColumnRenamed("pos", "_pos")
    first = rows.groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(F.min("_pos").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    return rows.join(first, same).select(*df.columns, (F.col("_pos") - F.col("_first")).alias("pos"))


def parted(pos: Column, total: Column, parts: int) -> Column:
    """Number of the equal part, from 0, in which a place lies; the first parts are one longer if need be."""
    size, longer = F.floor(total / parts), total % parts
    cut = longer * (size + 1)
    return F.when(pos < cut, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - cut) / F.greatest(size, F.lit(1)))).cast("int")
