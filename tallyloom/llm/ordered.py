"""Positions and running sums over a globally sorted frame, without one task seeing all rows.

Rows are dealt out by range and sorted inside each partition; a task numbers its own rows; the totals
of the partitions, of which there are as many as partitions, give each partition its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.storage import materialise


def positioned(df: DataFrame, order: list[Column], value: str, name: str, group: str | None = None) -> DataFrame:
    """``df`` in order with pos (rows before) and upto (sum of ``value`` up to and with the row), per group.

    ``order`` must sort a group's rows next to one another.  Nulls of ``group`` are one group, nulls
    of ``value`` count 0.  An empty frame gives an empty frame.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "pos", "upto"))])
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbering(value, group), schema)
    numbered = materialise(numbered, name)
    by = ["_part", *([group] if group else [])]
    totals = numbered.groupBy(*by).agg(F.max("pos").alias("_n"), F.max("upto").alias("_s"))
    if group is None:
        sums, rows, start = [], 0, 0
        for part, n, s in sorted(totals.collect()):  # a row for each partition
            sums.append((part, rows, start))
            rows, start = rows + n + 1, start + s
        offsets = F.broadcast(spark.createDataFrame(sums, "_part long, _rows long, _start long"))
        joined = numbered.join(offsets, "_part", "left")
    else:
        before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            F.col("_part").alias("_p"), F.col(group).alias("_g"),
            F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_rows"),
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"),
        )
        joined = numbered.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.select(
        *(F.col(c) for c in df.columns), (F.col("pos") + F.col("_rows")).alias("pos"), (F.col("upto") + F.col("_start")).alias("upto")
    )


def _numbering(value: str, group: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, rows, total = TaskContext.get().partitionId(), (), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = np.array([x or 0 for x in batch.column(value).to_pylist()], dtype=np.int64)
            keys = batch.column(group).to_pylist() if group else [None] * n
            first = np.array([not last or keys[0] != last[0], *(a != b for a, b in zip(keys, keys[1:]))])
            upto, at = np.cumsum(sizes), np.arange(n)
            start = np.maximum.accumulate(np.where(first, at, -1))
            carried = start < 0
            pos = np.where(carried, rows + at, at - start)
            sums = np.where(carried, total + upto, upto - (upto - sizes)[np.maximum(start, 0)])
            last, rows, total = (keys[-1],), int(pos[-1]) + 1, int(sums[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part)), pa.array(pos.astype(np.int64)), pa.array(sums.astype(np.int64))],
                names=[*batch.schema.names, "_part", "pos", "upto"],
            )

    return run
