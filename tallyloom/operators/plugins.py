"""What users add: summaries of rollouts, opaque scores, hooks around iterations, and functions in SQL, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A summary takes rollouts and returns name and value.
Summary = Callable[[DataFrame], DataFrame]


class Registry:
    """Constructors by name, called with the parameters of a configuration."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def add(self, name: str) -> Callable:
        def put(f: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{name} is there already")
            self._known[name] = f
            return f

        return put

    def make(self, name: str, **parameters):
        if name not in self._known:
            raise ValueError(f"{name} is none of {', '.join(sorted(self._known))}")
        return self._known[name](**parameters)


def apply_summaries(rollouts: DataFrame, summaries: dict[str, Summary]) -> DataFrame:
    """summary, name and value of every summary: each one is a plan of its own over the same rows."""
    found = [f(rollouts).select(F.lit(k).alias("summary"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value")) for k, f in summaries.items()]
    return reduce(DataFrame.union, found)


def opaque_summary(name: str, f: Callable[[Iterable], float], columns: list[str]) -> Summary:
    """A summary by a Python function over batches of rows: f takes an iterator of pandas frames and returns a number.

    All rows go through one task, batch by batch, so f should keep little; a plan of DataFrame operations is better.
    """

    def run(batches):
        import pandas as pd

        yield pd.DataFrame({"name": [name], "value": [float(f(batches))]})

    return lambda df: df.select(*columns).coalesce(1).mapInPandas(run, "name string, value double")


def scored(answer: Column, score: Callable[[str], float]) -> Column:
    """A Python score of answers, by Arrow batches."""

    def each(answers):
        return answers.map(score, na_action="ignore").astype("float64")

    import pandas as pd

    each.__annotations__ = {"answers": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, T.DoubleType())(answer)


class Hooks:
    """Calls before an iteration, before its new rollouts, and after it, around the batches of a stream."""

    def before_iteration(self, number: int) -> None: ...

    def before_new_rollouts(self, number: int) -> None: ...

    def after_iteration(self, number: int, batch: DataFrame) -> None: ...


def hooked(put: Callable[[DataFrame, int], None], hooks: list[Hooks]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that calls the hooks in order around ``put``."""

    def run(batch: DataFrame, number: int) -> None:
        for h in hooks:
            h.before_iteration(number)
        for h in hooks:
            h.before_new_rollouts(number)
        put(batch, number)
        for h in hooks:
            h.after_iteration(number, batch)

    return run


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions of the session: safe_min, safe_div, compact and slug."""
    bodies = {
        "safe_min(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(a, b)",
        "safe_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "try_divide(a, b)",
        "compact(t STRING) RETURNS STRING": "replace(t, ' ', '')",
        "slug(t STRING) RETURNS STRING": "trim(BOTH '_' FROM regexp_replace(t, '[^A-Za-z0-9_.-]+', '_'))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
