"""A table of evaluated checkpoints: comparison to a base, upserts, the best row, failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a log of a failure that may pass holds, in order of priority.
RETRYABLE = [
    "no cuda available", "cuda is not available", "no cuda", "free memory insufficient", "free memory on device", "insufficient free memory", "not enough free memory",
    "less than desired gpu memory utilization", "out of memory", "cuda out of memory", "connection refused", "failed to establish a new connection",
    "exceeded max retries on inference restarts",
]


def compare(rows: DataFrame, base: str, metrics: list[str], lower_better: list[str], by: str = "split", name: str = "experiment") -> DataFrame:
    """Ratio of each metric to the base row of the same split; base over row where lower is better."""
    bases = rows.filter(F.col(name) == base).select(by, *(F.col(m).alias(f"_b_{m}") for m in [*metrics, *lower_better]))
    joined = rows.join(bases, by, "left")
    ratio = {f"ratio_{m}": F.try_divide(m, f"_b_{m}") for m in [*metrics, *lower_better]}
    reduction = {f"reduction_{m}": F.try_divide(f"_b_{m}", m) for m in lower_better}
    return joined.withColumns(ratio | reduction).drop(*(f"_b_{m}" for m in [*metrics, *lower_better]))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones; columns are united."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(found: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return found.join(done, key, "left_anti")


def best(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The row of each group that is largest by ``order``; nulls lose."""
    w = Window.partitionBy(by).orderBy(*(c.desc_nulls_last() for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def iteration(name: Column) -> Column:
    """Number in checkpoint-N or ckptN, null if there is none."""
    return F.regexp_extract(name, r"(?:checkpoint-|ckpt)(\d+)", 1).try_cast("int")


def due(name: Column, every: int) -> Column:
    return F.coalesce(iteration(name) % every == 0, F.lit(False))


def failure_reason(log: Column) -> Column:
    """First known pattern in the log after its last command, null if none: then there is no use in a retry."""
    tail = F.lower(F.substring_index(F.right(log, F.lit(20000)), "# command_start", -1))
    return F.coalesce(*(F.when(F.contains(tail, F.lit(p)), F.lit(p)) for p in RETRYABLE))


def health(rss_gb: Column, host_percent: Column, steps: tuple[float, float, float, float] = (25, 35, 45, 65), host: float = 85) -> Column:
    """State of a server by its memory and its host's."""
    if not all(a < b for a, b in zip(steps, steps[1:])):
        raise ValueError("thresholds must increase")
    names = ("recycle_after_task", "draining", "soft_dead", "hard_dead")
    ladder = reduce(lambda c, x: c.when(rss_gb >= x[0], x[1]), list(zip(steps, names))[::-1], F.when(host_percent >= host, "hard_dead"))
    return ladder.otherwise("healthy")


#: Metrics of a checkpoint's rank, most important first; the last two are better the lower they are.
BEST = ("TGC", "SGC", "average_partial_pass_rate"), ("invalid_api_hits", "execution_failed_count")


def best_of_split(rows: DataFrame, split: str = "split", iteration_col: str = "checkpoint_iteration", name: str = "experiment_name") -> DataFrame:
    """The best row with an iteration of each split: a metric that is null or 0 ranks last, ties go by iteration as text, then name."""
    known = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0))
    high = [F.coalesce(known(c), F.lit(-1.0)).desc() for c in BEST[0]]
    low = [(-F.coalesce(known(c), F.lit(1e18))).desc() for c in BEST[1]]
    w = Window.partitionBy(split).orderBy(*high, *low, F.col(iteration_col).cast("string"), F.col(name))
    ranked = rows.filter(F.col(iteration_col).try_cast("double").isNotNull()).withColumn("_r", F.row_number().over(w))
    return ranked.filter("_r = 1").drop("_r")


def in_table_order(rows: DataFrame, split: str = "split", iteration_col: str = "checkpoint_iteration", name: str = "experiment_name") -> DataFrame:
    """Rows as the result table lists them: split, iteration as text ('10' before '2', none as 'None'), name."""
    return rows.orderBy(F.col(split), F.coalesce(F.col(iteration_col).cast("string"), F.lit("None")), F.col(name))


def log_tail(log: Column, most: int = 20_000) -> Column:
    return F.right(log, F.lit(most))


def allowed_split(name: str, allow_test: bool = False) -> str:
    """The split's name; an error for a test split unless it is allowed."""
    if name.startswith("test_") and not allow_test:
        raise ValueError(f"{name} is a test split")
    return name


def sampling_options(**options) -> dict:
    """The options; an error for those under which the served model's probabilities are not the trained one's."""
    bad = [k for k in ("min_p", "top_p", "top_k", "frequency_penalty") if options.get(k) is not None]
    if bad:
        raise ValueError(f"unsupported: {', '.join(bad)}")
    return options
