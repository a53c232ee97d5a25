"""Ordered operators: throughput, rolling means, spans, running totals, ranges, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.order import placed_in_groups, positioned
from tallyloom.storage import materialise


def throughput(df: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Increase of a running value a second over the last ``seconds``, two samples at least; null for the first.

    Times are seconds in double precision.  Each row asks at the time where its window begins: the next sample is the
    window's first, or else the one before is the row's predecessor (of samples at one time, the next lower value).
    Rows and askers are dealt out by range of key and time, so a key may lie in many partitions, and rows are read as
    often as before however many lie in a window; what a partition lacks are the last sample before it and the first
    after it.
    """
    spark = df.sparkSession
    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    asking = timed.withColumns({"_at": F.col("_t") - F.lit(float(seconds)), "_sample": F.lit(False)})
    samples = timed.select(key, value, "_t", F.col("_t").alias("_at"), F.lit(True).alias("_sample"))
    at = F.col("_at").asc_nulls_last()
    # more parts than tasks, as they are dealt out once more by hash
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asking.unionByName(samples, allowMissingColumns=True).repartitionByRange(parts, F.col(key), at)
    rows = materialise(dealt.withColumn("_part", F.spark_partition_id()), "throughput")

    sample = F.struct("_t", value)
    seen, so_far = F.when(F.col("_sample"), sample), (Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("_part", key)
    upward = own.orderBy(at, F.col("_sample"), F.col(value))
    downward = own.orderBy(F.col("_at").desc_nulls_first(), F.col("_sample").desc(), F.col(value).desc())
    near = rows.withColumns({
        "_before": F.last(seen, ignorenulls=True).over(upward.rowsBetween(*so_far)), "_after": F.last(seen, ignorenulls=True).over(downward.rowsBetween(*so_far)),
        "_tied": F.lag(F.when(~F.col("_sample"), sample)).over(upward),
    }).filter(~F.col("_sample"))

    in_order = F.when(F.col("_sample"), F.struct(F.col("_t").isNull(), "_t", value))
    ends = rows.groupBy("_part", key).agg(F.min(in_order).alias("_first"), F.max(in_order).alias("_last"))
    by_part = Window.partitionBy(key).orderBy("_part")
    around = ends.select(
        F.col("_part").alias("_p"), F.col(key).alias("_k"), F.count("*").over(Window.partitionBy(key)).alias("_parts"),
        F.last("_last", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
    ).filter("_parts > 1")
    joined = near.join(F.broadcast(around), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")

    either = lambda near, far: F.when(near.isNotNull(), near).otherwise(F.struct(far["_t"].alias("_t"), far[value].alias(value)))
    first, before = either(F.col("_after"), F.col("_later")), either(F.col("_before"), F.col("_earlier"))
    tied = F.col("_tied")
    start = F.when(first["_t"] < F.col("_t"), first).when(tied["_t"] == F.col("_t"), tied).otherwise(before)
    rate = (F.col(value) - start[value]) / F.greatest(F.col("_t") - start["_t"], F.lit(1e-8))
    return joined.select(*df.columns, rate.alias("per_second"))


def rolling_mean(df: DataFrame, key: str, order: str, value: str, last: int, burn_in: int = 1) -> DataFrame:
    """Mean of the last values, from the ``burn_in``-th on."""
    w = Window.partitionBy(key).orderBy(order)
    kept = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") >= burn_in).drop("_n")
    return kept.withColumn("rolling_mean", F.avg(value).over(w.rowsBetween(1 - last, 0)))


def exclusive_time(spans: DataFrame, span: str = "span", parent: str = "parent", seconds: str = "seconds") -> DataFrame:
    """Adds exclusive: a span's time without its direct children's."""
    inner = spans.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.sum(seconds).alias("_inner"))
    return spans.join(inner, F.col(span) == F.col("_p"), "left").withColumn("exclusive", F.col(seconds) - F.coalesce("_inner", F.lit(0))).drop("_p", "_inner")


def running_total(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_total", F.sum(value).over(w))


def ranges(df: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive numbers: first, last and length."""
    island = F.col(number) - F.dense_rank().over(Window.partitionBy(key).orderBy(number))
    return df.select(key, number, island.alias("_i")).groupBy(key, "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.countDistinct(number).alias("n")).drop("_i")


def expired(df: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """All but the last ``keep`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > keep).drop("_r")


def outlier_gate(df: DataFrame, key: str, order: str, value: str, most: float, sigmas: float = 5.0) -> DataFrame:
    """Adds accepted: not over ``most`` nor over mean + ``sigmas`` deviations of the accepted values before.

    The first three are only held against ``most``; what was rejected does not count later, so this is a
    loop over each key's rows in order, batch by batch: a key of any length needs the memory of four numbers.
    A null value is rejected.
    """
    names = df.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    by_key = df.repartition(F.col(key)).sortWithinPartitions(key, order)

    def run(batches):
        import pyarrow as pa

        last, n, mean, square = (), 0, 0.0, 0.0
        for batch in batches:
            flags = []
            for k, v in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(value)).to_pylist()):
                if (k,) != last:
                    last, n, mean, square = (k,), 0, 0.0, 0.0
                ok = v is not None and v <= most and (n < 3 or v <= mean + sigmas * (square / n) ** 0.5)
                if ok and v > 0:
                    n += 1
                    d = v - mean
                    mean += d / n
                    square += d * (v - mean)
                flags.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*names, "accepted"])

    return by_key.mapInArrow(run, f"{schema}, accepted boolean")


def ordinals(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds group_no (groups in order) and row_no (rows within them), both from 0."""
    groups = positioned(df.select(group).distinct(), [F.col(group)])
    rows = placed_in_groups(df, [group], [F.col(order)])
    numbered = rows.join(groups.select(group, F.col("pos").cast("int").alias("group_no")), group)
    return numbered.select(*df.columns, "group_no", F.col("pos").cast("int").alias("row_no"))


def range_text(df: DataFrame, key: str, number: str) -> DataFrame:
    """The numbers of each key as text: ``[0-2,4]``, or the number itself if there is one only."""
    runs = ranges(df, key, number)
    one = F.col("first").cast("string")
    text = F.when(F.col("first") == F.col("last"), one).otherwise(F.concat_ws("-", one, F.col("last").cast("string")))
    grouped = runs.withColumn("_t", text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "_t"))).alias("_r"), F.sum("n").alias("_n"))
    joined = F.array_join(F.transform("_r", lambda r: r["_t"]), ",")
    return grouped.select(key, F.when(F.col("_n") == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]"))).alias("text"))


def grouped_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Names of each key with those that differ in one numeric part written as one: ``layers.[0-2,4].proj``.

    Names are taken in the order of their reverse; one joins the group of those before it if it differs
    from the group's first in one part, and the numeric parts stand at the same places.  Where the part that
    differs is no number the group goes by its first name.  Greedy and dependent on order, so a key's different
    names go through one Python call; they are the parameters of one model.
    """

    def parsed(n: str) -> tuple[list[str], list[int]]:
        parts = n.split(".")
        return parts, [k for k, p in enumerate(parts) if p.isdigit()]

    def compact(numbers: set[int]) -> str:
        runs: list[list[int]] = []
        for x in sorted(numbers):
            if runs and x == runs[-1][1] + 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        return "[" + ",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs) + "]"

    def written(group: list[tuple[list[str], list[int]]]) -> str:
        first, places = group[0]
        for k in places:
            if len(numbers := {int(parts[k]) for parts, _ in group}) > 1:
                return ".".join([*first[:k], compact(numbers), *first[k + 1 :]])
        return ".".join(first)

    def run(pdf):
        import pandas as pd

        groups: list[list[tuple[list[str], list[int]]]] = []
        for n in map(parsed, sorted(pdf[name], key=lambda v: v[::-1])):
            head = groups[-1][0] if groups else None
            if head and len(head[0]) == len(n[0]) and head[1] == n[1] and sum(a != b for a, b in zip(head[0], n[0])) == 1:
                groups[-1].append(n)
            else:
                groups.append([n])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(groups), "names": [written(g) for g in groups]})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, names string"
    return df.select(key, name).distinct().groupBy(key).applyInPandas(run, schema)


def span_summary(spans: DataFrame, name: str = "name", seconds: str = "seconds", count: str = "count", span: str = "span", parent: str = "parent", order: str = "span", last: int = 100, burn_in: int = 3) -> DataFrame:
    """Means of inclusive and exclusive time over the last spans of each name, throughput and total time.

    Of each name the first ``burn_in`` - 1 spans do not count in the means, and the ``last`` ones do; throughput is their
    elements over their time.  total_time counts every span.
    """
    timed = exclusive_time(spans, span, parent, seconds)
    at = Window.partitionBy(name)
    ranked = timed.withColumns({"_n": F.row_number().over(at.orderBy(order)), "_r": F.row_number().over(at.orderBy(F.col(order).desc()))})
    used = (F.col("_n") >= burn_in) & (F.col("_r") <= last)
    own = lambda c: F.when(used, F.col(c))
    return ranked.groupBy(name).agg(
        F.avg(own(seconds)).alias("inclusive"), F.avg(own("exclusive")).alias("exclusive"), F.try_divide(F.sum(own(count)), F.sum(own(seconds))).alias("throughput"), F.sum(seconds).alias("total_time"),
    ).filter(F.col("inclusive").isNotNull())


def running_statistics(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds mean and deviation (of the population) of the positive values so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    positive = F.when(F.col(value) > 0, F.col(value))
    return df.withColumns({"running_mean": F.avg(positive).over(w), "running_std": F.stddev_pop(positive).over(w)})
