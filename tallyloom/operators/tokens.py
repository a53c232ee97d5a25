"""Statistics over token-aligned arrays; everything stays in array expressions, no row is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(values: str | Column, mask: str) -> Column:
    """The values at output positions."""
    values = F.col(values) if isinstance(values, str) else values
    pairs = F.filter(F.arrays_zip(values.alias("v"), F.col(mask).alias("m")), lambda x: x["m"])
    return F.transform(pairs, lambda x: x["v"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def log_ratios(df: DataFrame) -> DataFrame:
    """Adds d: new minus old log-probability at the output positions."""
    return df.withColumn("d", masked(F.zip_with("new_lp", "old_lp", lambda a, b: a - b), "is_output"))


def truncated(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Parallel arrays cut to ``most`` positions, with a flag."""
    long = F.size(columns[0]) > most
    return df.withColumns({**{c: F.slice(c, 1, most) for c in columns}, "was_truncated": long})


def divergences(df: DataFrame) -> DataFrame:
    """kl_k1 = -mean(d) and kl_k3 = mean(exp(d) - 1 - d) of each rollout."""
    return df.withColumns({"kl_k1": -mean(F.col("d")), "kl_k3": mean(F.transform("d", lambda x: F.exp(x) - 1 - x))})


def importance(df: DataFrame) -> DataFrame:
    """Weight of each trajectory, and extremes of the token differences with their first positions (0-based)."""
    low, high = F.array_min("d"), F.array_max("d")
    return df.withColumns({"weight": F.exp(total(F.col("d"))), "d_min": low, "d_max": high, "argmin": F.array_position("d", low) - 1, "argmax": F.array_position("d", high) - 1})


def clipped(advantage: Column, weight: Column, epsilon: float) -> Column:
    """PPO objective with weights kept in [1 / (1 + epsilon), 1 + epsilon]."""
    bounded = F.greatest(F.least(weight, F.lit(1 + epsilon)), F.lit(1 / (1 + epsilon)))
    return F.least(advantage * weight, advantage * bounded)


def surrogate(df: DataFrame, advantage: Column, per_token: bool, clip: bool, epsilon: float = 0.1, kl_term: Column | float = 0.0) -> DataFrame:
    """Adds objective (mean over tokens, or of the trajectory) and clipped_fraction.

    ``kl_term`` is added to the advantage: the weight of the KL penalty times the rollout's log importance weight.
    """
    advantage = advantage + (F.lit(kl_term) if isinstance(kl_term, float) else kl_term)
    one = lambda w: clipped(advantage, w, epsilon) if clip else advantage * w
    outside = lambda w: (one(w) != advantage * w).cast("double")
    if per_token:
        weights = F.transform("d", F.exp)
        return df.withColumns({"objective": mean(F.transform(weights, one)), "clipped_fraction": mean(F.transform(weights, outside))})
    weight = F.exp(total(F.col("d")))
    return df.withColumns({"objective": one(weight), "clipped_fraction": outside(weight)})


def joined_in_order(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Parallel arrays of a key's rows put one after another by ``order``; one row a key."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    grouped = df.groupBy(key).agg(rows.alias("_r"))
    whole = lambda c: F.flatten(F.filter(F.transform("_r", lambda r: r[c]), lambda x: x.isNotNull()))
    return grouped.select(key, *(whole(c).alias(c) for c in columns))


def aligned(messages: DataFrame, stops: list[int], end: int, newline: list[int]) -> DataFrame:
    """Adds tokens, is_output and log_probs of each message, three arrays of one length.

    A policy message has its prompt_tokens, then generated_tokens, then ``end`` if it was cut off (stopped) without one
    of ``stops`` or generated nothing, then ``newline``; only generated tokens are output and have log-probabilities, others
    NaN.  Any other message has its own message_tokens.
    """
    none, nan = F.array().cast("array<int>"), F.lit(float("nan"))
    own = lambda c: F.coalesce(c, none)
    prompt, made = own(F.col("prompt_tokens")), own(F.col("generated_tokens"))
    ended = F.coalesce(F.arrays_overlap(F.slice(made, -1, 1), F.array(*map(F.lit, stops))), F.lit(False))
    cut = (F.size(made) == 0) | (F.coalesce(F.col("stopped"), F.lit(False)) & ~ended)
    tail = F.concat(F.when(cut, F.array(F.lit(end))).otherwise(none), F.array(*map(F.lit, newline)).cast("array<int>"))
    some = lambda value, tokens: F.transform(tokens, lambda _: value)
    other, policy = own(F.col("message_tokens")), F.col("policy")
    return messages.withColumns({
        "tokens": F.when(policy, F.concat(F.when(F.size(made) > 0, F.concat(prompt, made)).otherwise(prompt), tail)).otherwise(other),
        "is_output": F.when(policy, F.concat(some(F.lit(False), prompt), some(F.lit(True), made), some(F.lit(False), tail))).otherwise(some(F.lit(False), other)),
        "log_probs": F.when(policy, F.concat(some(nan, prompt), F.coalesce("generated_logprobs", F.array().cast("array<double>")), some(nan, tail))).otherwise(some(nan, other)),
    })


def percentile_of(values: Column, share: float) -> Column:
    """Exact percentile of an array's values with linear interpolation."""
    ordered, place = F.sort_array(values), (F.size(values) - 1) * share
    low, high = (F.element_at(ordered, f(place).cast("int") + 1) for f in (F.floor, F.ceil))
    return F.when(F.size(values) > 0, low + (high - low) * (place - F.floor(place)))


def recompute_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """How recomputed log-probabilities differ from old ones: for each rollout within its arrays, then over ``by``."""
    new, old = masked("new_lp", "is_output"), masked("old_lp", "is_output")
    lp = F.zip_with(new, old, lambda a, b: F.abs(a - b))
    p = F.zip_with(new, old, lambda a, b: F.abs(F.exp(a) - F.exp(b)))
    weight = F.zip_with(new, old, lambda a, b: F.exp(a) / F.greatest(F.exp(b), F.lit(1e-12)))
    each = df.withColumns({"_lp": lp, "_p": p, "_w": weight}).select(
        *by, mean(F.col("_lp")).alias("alp"), F.array_max("_lp").alias("mlp"), mean(F.col("_p")).alias("ap"), F.array_max("_p").alias("mp"),
        percentile_of(F.col("_p"), 0.95).alias("p95"), percentile_of(F.col("_p"), 0.99).alias("p99"), F.array_min("_w").alias("lw"), F.array_max("_w").alias("hw"),
    )
    return each.groupBy(*by).agg(
        F.avg("alp").alias("avg_logprob_diff"), F.max("mlp").alias("max_logprob_diff"), F.avg("ap").alias("avg_prob_diff"), F.max("mp").alias("max_prob_diff"),
        F.max("p95").alias("max_p95_prob_diff"), F.max("p99").alias("max_p99_prob_diff"), F.min("lw").alias("min_imp_weight"), F.max("hw").alias("max_imp_weight"),
    )


def drifted(df: DataFrame, most: float) -> DataFrame:
    """Rollouts whose tokens' log-probabilities differ by more than ``most`` anywhere, with their extremes (before any step is made)."""
    own = importance(log_ratios(df))
    return own.filter(F.greatest("d_max", -F.col("d_min")) > most)


def no_drift(df: DataFrame, key: str, most: float) -> DataFrame:
    """The rows as they are; an error that names the rollout where one differs by more than ``most``."""
    own = importance(log_ratios(df))
    bad = F.greatest("d_max", -F.col("d_min")) > most
    said = F.concat(F.lit(f"log-probabilities differ by more than {most} in "), F.col(key).cast("string"))
    return own.withColumn(key, F.when(bad, F.raise_error(said).cast(df.schema[key].dataType)).otherwise(F.col(key))).select(*df.columns)


def loss_gate(df: DataFrame, by: list[str], loss: str, log_weight: str, high_kl: float = 20.0) -> DataFrame:
    """Mean loss and KL estimate of each step, and what becomes of it: skip (no number), stop (KL too high) or step."""
    kl = -F.avg(log_weight)
    found = df.groupBy(*by).agg(F.avg(loss).alias("avg_loss"), kl.alias("kl_estimate"))
    action = F.when(F.isnan("avg_loss") | F.col("avg_loss").isNull(), "skip").when(F.abs("kl_estimate") > high_kl, "stop").otherwise("step")
    return found.withColumn("action", action)


def clip_coefficient(df: DataFrame, by: list[str], value: str, most: float, p: float = 2.0) -> DataFrame:
    """The p-norm (``inf`` allowed) of each group's values and the factor, 1 at most, that brings it to ``most``."""
    norm = F.max(F.abs(value)) if p == float("inf") else F.pow(F.sum(F.pow(F.abs(value), p)), 1 / p)
    return df.groupBy(*by).agg(norm.alias("norm")).withColumn("coefficient", F.least(F.lit(1.0), most / (F.col("norm") + 1e-6)))
