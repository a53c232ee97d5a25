"""Quality metrics of evaluated rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reward(sparse: bool, exec_penalty: float = 0.0, no_code_penalty: float = 0.0, no_code: Column | None = None) -> Column:
    """1 for success if sparse, else passes over tests less penalties, 0 at least."""
    if min(exec_penalty, no_code_penalty) < 0:
        raise ValueError("penalties must not be negative")
    if sparse:
        return F.col("success").cast("double")
    none = F.lit(0) if no_code is None else no_code
    return F.greatest(F.lit(0.0), F.col("passes") / F.col("num_tests") - exec_penalty * F.col("n_exec_failed") - no_code_penalty * none)


def summary(df: DataFrame, *by: str) -> DataFrame:
    """Successes, rollouts, success rate (TGC) and mean pass rate, for each group."""
    rate = F.avg(F.col("success").cast("double"))
    return df.groupBy(*by).agg(F.count_if("success").alias("n_successes"), F.count("*").alias("n_tasks"), rate.alias("tgc"), F.avg(F.col("passes") / F.col("num_tests")).alias("avg_pass_rate"))


def with_total(df: DataFrame, by: str) -> DataFrame:
    """Counts for each group and, where the group is null, in total."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.count_if("success").alias("n_successes"))


def macro_success(df: DataFrame, by: str) -> DataFrame:
    """Mean of the groups' success rates."""
    return df.groupBy(by).agg(F.avg(F.col("success").cast("double")).alias("rate")).agg(F.count("*").alias("n_groups"), F.avg("rate").alias("macro_success"))


def histogram(df: DataFrame, by: str, ret: str = "ret", bins: int = 10) -> DataFrame:
    """Counts of returns in equal bins of [0, 1], the last one closed."""
    bin_ = F.least(F.floor(F.col(ret) * bins), F.lit(bins - 1)) + 1
    return df.groupBy(by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def best_return(df: DataFrame, *by: str) -> DataFrame:
    """Best return of each task, 0 at least."""
    return df.groupBy(*by).agg(F.greatest(F.max("ret"), F.lit(0.0)).alias("best"))


def attained_full(df: DataFrame, *by: str) -> DataFrame:
    """Share of tasks whose best return is 1."""
    return best_return(df, *by).agg(F.count("*").alias("n_tasks"), F.avg((F.col("best") == 1.0).cast("double")).alias("attained_full"))


def scenario_completion(df: DataFrame, scenario: str, task: str) -> DataFrame:
    """Share of scenarios (SGC) all of whose tasks have a success."""
    tasks = df.groupBy(scenario, task).agg(F.bool_or("success").alias("ok"))
    return tasks.groupBy(scenario).agg(F.bool_and("ok").alias("ok")).agg(F.count("*").alias("n_scenarios"), F.avg(F.col("ok").cast("double")).alias("sgc"))


def named(df: DataFrame, source: str, difficulty: str, prefix: str = "") -> DataFrame:
    """name and value of each group's metrics: ``<metric>__<group>``, with the mean over difficulties and the total.

    Long format: as many rows as groups, so that new groups need no new columns; ``wide`` gives columns.
    """
    success = F.avg(F.col("success").cast("double"))
    by_source = df.groupBy(F.col(source).cast("string").alias("g")).agg(success.alias("source_success_rate"), F.avg("ret").alias("source_avg_return"))
    by_difficulty = df.groupBy(F.col(difficulty).cast("string").alias("g")).agg(success.alias("success_rate"), F.count("*").cast("double").alias("n_rollouts"))
    over = by_difficulty.agg(F.avg("success_rate").alias("success_rate__avg_over_dfcty"), F.sum("n_rollouts").alias("n_rollouts__total"))
    parts = [f.unpivot(["g"], f.columns[1:], "m", "value").select(F.concat_ws("__", "m", "g").alias("name"), "value") for f in (by_source, by_difficulty)]
    totals = over.unpivot([], over.columns, "name", "value")
    return parts[0].union(parts[1]).union(totals).select(F.concat(F.lit(prefix), "name").alias("name"), "value")


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row with a column for each of the named metrics, null for those that are not there."""
    return metrics.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def throughput(df: DataFrame, elapsed: float) -> DataFrame:
    """Output tokens and rollouts a second of one evaluation; df has n_output for each rollout."""
    total = F.coalesce(F.sum("n_output"), F.lit(0))
    return df.agg(total.alias("output_tokens_per_iteration"), (total / elapsed).alias("output_tokens_per_sec"), (F.count("*") / elapsed).alias("rollouts_per_sec"))


def peak_memory(df: DataFrame, key: str, peak: str, items: str) -> DataFrame:
    """Mean peak in MB by key, and a MB an item, null if any measurement had no items."""
    mb = F.col(peak) / 1024**2
    return df.groupBy(key).agg(F.avg(mb).alias("mb_peak"), F.when(F.min(F.col(items) != 0), F.avg(F.try_divide(mb, items))).alias("mb_per_item"))


def of_difficulty(df: DataFrame, difficulty: int) -> DataFrame:
    return df.filter(F.col("difficulty") == difficulty)


def averages(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Mean of each column a rollout, and how many rollouts were cancelled."""
    return df.groupBy(*by).agg(*((F.sum(c) / F.count("*")).alias(n) for n, c in columns.items()), F.count_if("cancelled").alias("n_cancelled"))
