"""Iterations as gated batches, early stopping, retries, and streamed rates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources import paths

STATES = ("pending", "committed", "aborted")


class Gate:
    """Two-phase commits of iterations, in a folder of manifests that are published once and never changed.

    An attempt has two files: one when it begins and one when it ends, committed or aborted.  Each is created only if it
    is not there, which a file system decides for one writer alone, so of two that begin the same attempt or end it one
    fails.  A job that dies leaves a pending attempt, and a second begin is the next attempt; earlier files are the
    history.
    """

    SCHEMA = "iteration int, attempt int, status string, expected int, finished int, reason string, at string"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))

    def history(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def current(self) -> DataFrame:
        """The state of each iteration: the end of its last attempt, or its begin."""
        ended = F.col("status") != "pending"
        rows = self.history().withColumn("_o", F.struct("attempt", ended))
        return latest(rows, ["iteration"], "_o").drop("_o")

    def _publish(self, iteration: int, attempt: int, part: str, **values) -> None:
        import json
        from datetime import UTC, datetime

        name = f"iteration-{iteration:06d}-attempt-{attempt:03d}-{part}.json"
        row = {"iteration": iteration, "attempt": attempt, **values, "at": datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")}
        try:
            out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), False)
        except Exception as taken:
            raise ValueError(f"{name} is there already") from taken
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def _state(self, iteration: int):
        return self.current().filter(F.col("iteration") == iteration).first()

    def begin(self, iteration: int, expected: int) -> int:
        old = self._state(iteration)
        attempt = old.attempt + 1 if old else 0
        self._publish(iteration, attempt, "begin", status="pending", expected=expected, finished=0)
        return attempt

    def commit(self, iteration: int, finished: int, least_share: float = 1.0) -> None:
        state = self._state(iteration)
        if state is None or state.status != "pending":
            raise ValueError(f"iteration {iteration} is not pending")
        if finished < math.ceil(state.expected * least_share):
            raise ValueError(f"{finished} of {state.expected} rows are finished")
        self._publish(iteration, state.attempt, "end", status="committed", expected=state.expected, finished=finished)

    def abort(self, iteration: int, reason: str, finished: int | None = None) -> None:
        state = self._state(iteration)
        if state is not None and state.status == "pending":
            self._publish(iteration, state.attempt, "end", status="aborted", expected=state.expected, finished=state.finished if finished is None else finished, reason=reason)

    def assert_committed(self, iteration: int) -> None:
        state = self._state(iteration)
        if state is None or state.status != "committed":
            raise ValueError(f"iteration {iteration} is not committed")


#: Reasons of an abort after which a run is started again.
HARD_DEAD = ["appworld_server_rss_65gb", "host_memory_used_85pct"]


def hard_dead(status: Column, reason: Column) -> Column:
    """Whether a manifest tells of an abort for memory."""
    return F.coalesce((status == "aborted") & reason.isin(HARD_DEAD), F.lit(False))


def attempts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds attempt: how many rows of the same key came before."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def complete_batches(expected: DataFrame, rows: DataFrame, key: list[str], count: str) -> DataFrame:
    """Keys of which fewer or more rows are there than expected: key, expected and found."""
    found = rows.groupBy(*key).agg(F.count("*").alias("found"))
    both = expected.select(*key, F.col(count).alias("expected")).join(found, key, "full")
    both = both.select(*key, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("found", F.lit(0)).cast("long").alias("found"))
    return both.filter("expected <> found")


def after_stop(results: DataFrame, stop: DataFrame, by: str, order: str) -> DataFrame:
    """Rows that came in time, and how many later or cancelled ones were dropped, of each ``by``; stop has one row."""
    late = F.col("cancelled") | (F.col(order) > F.col("stop_at"))
    marked = results.crossJoin(F.broadcast(stop.select("stop_at"))).withColumn("_late", F.coalesce(late, F.col("cancelled")))
    return marked.groupBy(by).agg(F.count_if(~F.col("_late")).alias("n_collected"), F.count_if("_late").alias("n_dropped"))


def iteration_budget(attempts_: DataFrame, iteration: str, key: str, order: str, per_key: int, per_iteration: int) -> DataFrame:
    """What becomes of each soft-dead attempt, in order: retried, or the iteration is aborted at it.

    A key may be retried ``per_key`` times and an iteration ``per_iteration`` times in all; attempts after an abort do not
    count.
    """
    dead = attempts_.filter("soft_dead")
    marked = dead.withColumns({"_k": F.row_number().over(Window.partitionBy(iteration, key).orderBy(order)), "_i": F.row_number().over(Window.partitionBy(iteration).orderBy(order))})
    refused = (F.col("_k") > per_key) | (F.col("_i") > per_iteration)
    first = F.min(F.when(refused, F.col(order))).over(Window.partitionBy(iteration))
    told = marked.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(order) <= F.col("_first")))
    return told.withColumn("outcome", F.when(F.col(order) == F.col("_first"), "abort").otherwise("retry")).drop("_k", "_i", "_first")


def requests(df: DataFrame, key: str, order: str, wanted: str, taken: str) -> DataFrame:
    """Adds requested: how many items the producer of each key is asked for at each step.

    At each step ``wanted`` items must be there or on their way, and after it ``taken`` items leave; what is asked for
    tops that up, so all requests up to a step come to the most that was ever wanted plus what had left by then.
    """
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    level = df.withColumn("_level", F.col(wanted) + F.coalesce(F.sum(taken).over(earlier), F.lit(0)))
    asked = F.max("_level").over(so_far) - F.coalesce(F.max("_level").over(earlier), F.lit(0))
    return level.withColumn("requested", F.greatest(asked, F.lit(0))).drop("_level")


CHUNK = "struct<error:string,choices:array<struct<text:string,finish_reason:string,logprobs:struct<tokens:array<string>,token_logprobs:array<double>>>>>"


def streamed_texts(chunks: DataFrame, key: str, order: str, column: str = "value", prefix: str = "data: ", final: str = "[DONE]") -> DataFrame:
    """Text, tokens and log-probabilities of each server-sent stream, from its chunks in order as far as the final one.

    stopped_by_limit is whether the last reason to finish was the length.  A chunk without ``prefix`` is an error.
    """
    bad = F.raise_error(F.concat(F.lit("not a data chunk: "), F.col(column))).cast("string")
    body = F.when(F.startswith(column, F.lit(prefix)), F.trim(F.substring(F.col(column), len(prefix) + 1, 1 << 30))).otherwise(bad)
    own = chunks.select(key, order, body.alias("_b"))
    ended = F.min(F.when(F.col("_b") == final, F.col(order))).over(Window.partitionBy(key))
    own = own.withColumn("_end", ended).filter(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    choice = F.from_json("_b", CHUNK)["choices"][0]
    parts = F.array_sort(F.collect_list(F.struct(order, choice["text"].alias("text"), choice["finish_reason"].alias("reason"), choice["logprobs"]["tokens"].alias("tokens"), choice["logprobs"]["token_logprobs"].alias("lps"))))
    whole = own.groupBy(key).agg(parts.alias("_p"), F.max_by(choice["finish_reason"], F.when(choice["finish_reason"].isNotNull(), F.col(order))).alias("_reason"))
    number = lambda t: F.regexp_extract(t, r"^token_id:(\d+)$", 1).try_cast("int")
    return whole.select(
        key, F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"), F.transform(F.flatten(F.filter(F.transform("_p", lambda p: p["tokens"]), lambda t: t.isNotNull())), number).alias("tokens"),
        F.flatten(F.filter(F.transform("_p", lambda p: p["lps"]), lambda t: t.isNotNull())).alias("log_probs"), F.coalesce(F.col("_reason") == "length", F.lit(False)).alias("stopped_by_limit"),
    )


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def orphans(manifests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Committed iterations without a finished checkpoint, which are to be run again."""
    return manifests.filter("status = 'committed'").join(checkpoints, "iteration", "left_anti")


def early_stop(results: DataFrame, scenarios: int, rollouts: int, order: str, share: float, scenario_share: float) -> DataFrame:
    """The first row by ``order`` at which enough rows, and enough of each scenario, are there; none if never.

    A scenario has enough at its k-th row, so the stop is the latest of those and of the n-th row in all:
    two aggregates over row numbers instead of state for every row.
    """
    need, each = math.ceil(scenarios * share) * rollouts, round(rollouts * scenario_share)
    live = results.filter("NOT cancelled")
    at_total = live.orderBy(order).limit(need).agg(F.count("*").alias("n"), F.max(order).alias("at"))
    nth = live.withColumn("_k", F.row_number().over(Window.partitionBy("scenario").orderBy(order))).filter(F.col("_k") == max(each, 1))
    at_each = nth.agg(F.count("*").alias("m"), F.max(order).alias("each_at"))
    both = at_total.crossJoin(at_each).filter((F.col("n") == need) & ((F.col("m") == scenarios) | F.lit(each < 1)))
    return both.select(F.greatest("at", F.when(F.lit(each >= 1), F.col("each_at"))).alias("stop_at"), F.lit(need).alias("needed"), F.lit(each).alias("needed_each"))


def within_budget(attempts: DataFrame, key: str, order: str, per_key: int) -> DataFrame:
    """Failed attempts that may be retried: fewer than ``per_key`` failures up to them, and none that succeeded."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    marked = attempts.withColumns({"_f": F.count_if(F.col("failed")).over(w), "_ok": F.count_if(~F.col("failed")).over(whole)})
    return marked.filter(F.col("failed") & (F.col("_f") <= per_key) & (F.col("_ok") == 0)).drop("_f", "_ok")


def event_rates(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", session: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or session windows, for a batch or a stream; late rows go past the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    window = F.session_window("ts", session) if session else F.window("ts", every)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def commit_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch under its number; a repeated batch replaces itself, so results appear once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def watch(found: DataFrame, seen: str, checkpoint: str, key: list[str], done: Callable[[], DataFrame], gate: Callable[[], bool], evaluate: Callable[[DataFrame], None], every: str | None = None):
    """Evaluate what a stream finds and is not done yet, whenever the gate is open.

    found: a stream of what is due, such as complete checkpoints of the right cadence.  All that was seen stays in a
    table under ``seen``, so what came while the gate was closed is evaluated at a later poll.  With ``every`` ("1 minute")
    the poll goes on; without, it ends when all there is has been looked at.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        if gate():
            all_ = batch.sparkSession.read.parquet(seen).drop("batch").dropDuplicates(key)
            evaluate(all_.join(done(), key, "left_anti"))

    writer = found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upload(spark: SparkSession, source: str, target: str, marker: str = "done.txt") -> None:
    """Copy a checkpoint's folder and then its mark, so that a folder with the mark is whole."""
    paths.copy(spark, source, target)
    paths.write_bytes(spark, f"{target}/{marker}", b"done\n")
