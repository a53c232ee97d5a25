"""How agents behave: values of single episodes, and rows of rates for experiments and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import transcripts as tr
from tallyloom.operators.checkpoints import iteration

KEYS = ["experiment", "task_id"]


def rate(value: Column, by: Column) -> Column:
    """value / by, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(value.cast("double"), by), F.lit(0.0))


def episode_values(episodes: DataFrame, patterns: list[str] = tr.INVALID_API) -> DataFrame:
    """A row for each episode with its verdicts, counters and hits of ``patterns`` in all its text.

    Absent counters count as 0, absent verdicts as failures, and a task without tests passes none.
    """
    said = _all_text(episodes)
    tests, passes = F.coalesce("eval_result.num_tests", F.lit(0)), F.coalesce(F.size("eval_result.passes"), F.lit(0))
    passes = F.greatest(passes, F.lit(0))  # the size of null may be -1
    return episodes.select(
        *KEYS, F.coalesce("eval_result.success", F.lit(False)).alias("success"), rate(passes, F.when(tests > 0, tests)).alias("pass_rate"),
        F.col("eval_result.difficulty").alias("difficulty"), F.col("eval_result.num_interactions").alias("num_interactions"),
        F.coalesce("n_execution_failed", F.lit(0)).cast("long").alias("n_execution_failed"), F.coalesce("n_no_code_found", F.lit(0)).cast("long").alias("n_no_code_found"),
        F.coalesce("cancelled", F.lit(False)).alias("cancelled"), tr.invalid_api_hits(said, patterns).alias("invalid_api_hits"),
        *(tr.count_pattern(said, p).alias(n) for n, p in (("assumption_words", tr.ASSUMPTION), ("assumption_words_extended", tr.ASSUMPTION_EXTENDED), ("dummy_words", tr.DUMMY), ("dummy_words_extended", tr.DUMMY_EXTENDED))),
    )


def _all_text(episodes: DataFrame) -> Column:
    return F.array_join(tr.text_values(F.col("chat_history"), episodes.schema["chat_history"].dataType), "\n")


def summary(values: DataFrame) -> DataFrame:
    """Rates and totals of an experiment's episodes, from ``episode_values``."""
    n = F.count("*")
    share = lambda c: rate(F.count_if(c), n)
    return values.groupBy("experiment").agg(
        n.alias("episodes"), share(F.col("success")).alias("success_rate"), F.coalesce(F.avg("pass_rate"), F.lit(0.0)).alias("avg_subtest_pass_rate"),
        F.coalesce(F.avg("num_interactions"), F.lit(0.0)).alias("avg_num_interactions"), F.sum("n_execution_failed").alias("execution_failed_total"),
        share(F.col("n_execution_failed") > 0).alias("execution_failed_task_rate"), F.sum("n_no_code_found").alias("no_code_found_total"), share(F.col("n_no_code_found") > 0).alias("no_code_found_task_rate"),
        F.sum("invalid_api_hits").alias("invalid_api_regex_hits"), share(F.col("invalid_api_hits") > 0).alias("invalid_api_task_rate"), F.count_if("cancelled").alias("cancelled_total"),
    )


def turns(episodes: DataFrame) -> DataFrame:
    """A row for each turn: what the assistant said, the observation, blocks of code, calls, and whether it failed.

    One shuffle by episode; the windows and aggregates after it keep its partitioning.
    """
    each = episodes.select(*KEYS, F.coalesce("num_prompt_messages", F.lit(0)).alias("_skip"), F.posexplode("chat_history").alias("msg_idx", "m"))
    said = each.filter("msg_idx >= _skip").select(*KEYS, "msg_idx", F.col("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("text"))
    pairs = tr.turn_pairs(said, KEYS, "msg_idx")
    blocks = pairs.withColumn("blocks", tr.code_blocks(F.col("said")))
    return blocks.withColumns({"calls": F.flatten(F.transform("blocks", tr.api_calls)), "failed": F.contains("observation", F.lit(tr.FAILED))})


def events(turns_: DataFrame) -> DataFrame:
    """Documentation read and calls made, each with its place (turn, block, position) in the episode."""
    blocks = turns_.select(*KEYS, "turn_no", F.posexplode("blocks").alias("block_no", "code"))
    found = blocks.select(*KEYS, "turn_no", "block_no", F.posexplode(tr.code_events(F.col("code"))).alias("at", "e"))
    return found.select(*KEYS, F.struct("turn_no", "block_no", "at").alias("pos"), "e.*")


def behaviour(episodes: DataFrame) -> DataFrame:
    """The behaviour row of every experiment: counts and rates over its episodes, turns, calls and words.

    An episode without turns counts with its num_interactions.  Calls are counted once a turn; a failed
    one is recovered if a later turn without a failure makes it.
    """
    values = episode_values(episodes)
    said = turns(episodes)
    in_order = Window.partitionBy(*KEYS).orderBy("turn_no")
    total = lambda f: F.aggregate(F.transform("blocks", f), F.lit(0).cast("long"), lambda a, x: a + x)
    docs = lambda name: lambda b: tr.count_pattern(b, tr.DOCS_CALL.format(name))
    gave_up = F.col("failed") & F.coalesce(F.lead("said").over(in_order).rlike(tr.CAPITULATION), F.lit(False))
    per_turn = said.withColumn("_gave_up", gave_up).groupBy(*KEYS).agg(
        F.count("*").alias("n_turns"), F.sum(total(lambda b: F.length(b).cast("long"))).alias("code_chars"), F.count_if(F.size("blocks") > 1).alias("many_blocks"),
        F.count_if("failed").alias("errors"), F.sum(total(docs(tr.SHOW))).alias("docs"), F.sum(total(docs(tr.DESCRIBE))).alias("descriptions"), F.count_if("_gave_up").alias("capitulations"),
    )
    episode = F.struct(*KEYS).alias("episode")
    documented = tr.documented_before(events(said).select(episode, "pos", "kind", "app", "api")).select("episode.*", "n_calls", "n_documented")
    calls = said.select(episode, F.col("turn_no").alias("turn"), F.explode(F.array_distinct("calls")).alias("endpoint"), "failed")
    recovered = tr.recovery(calls).select("episode.*", "n_failed", "n_recovered")
    all_ = values.join(per_turn, KEYS, "left").join(documented, KEYS, "left").join(recovered, KEYS, "left")
    all_ = all_.withColumn("n_turns", F.coalesce("n_turns", "num_interactions", F.lit(0)))
    n, s = F.count("*"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    of_all = lambda c: rate(s(c), n)
    of_turns = lambda c: rate(s(c), s("n_turns"))
    return all_.groupBy("experiment").agg(
        of_all("pass_rate").alias("average_partial_pass_rate"), s("n_execution_failed").alias("execution_failed_count"), s("invalid_api_hits").alias("invalid_api_hits"),
        n.alias("num_rollouts_analyzed"), of_all("n_turns").alias("num_turns_avg"), of_all("code_chars").alias("code_chars_per_rollout"),
        of_turns("many_blocks").alias("multiple_code_cells_per_turn"), of_turns("errors").alias("execution_errors_per_turn"), of_all("docs").alias("api_doc_calls_per_rollout"),
        of_all("descriptions").alias("api_description_calls_per_rollout"), rate(s("docs") + s("descriptions"), n).alias("api_doc_or_description_calls_per_rollout"),
        rate(s("n_documented"), s("n_calls")).alias("doc_before_api_call_rate"), of_all("assumption_words").alias("assumption_words_per_rollout"),
        of_all("assumption_words_extended").alias("assumption_words_extended_per_rollout"), of_all("dummy_words").alias("dummy_words_per_rollout"),
        of_all("dummy_words_extended").alias("dummy_words_extended_per_rollout"), rate(s("n_failed") - s("n_recovered"), s("n_failed")).alias("failed_api_call_give_up_rate"),
        s("n_failed").alias("failed_api_calls"), s("n_recovered").alias("recovered_api_calls"), s("capitulations").alias("capitulation_after_error_count"),
    )


def checkpoint_row(behaviour_: DataFrame, official: DataFrame, name: Column, paths: dict[str, str]) -> DataFrame:
    """A checkpoint's row: its name and iteration, the official metrics (one row), behaviour and where its files are."""
    named = behaviour_.withColumns({"checkpoint_name": name, "checkpoint_iteration": iteration(name)})
    return named.crossJoin(official).withColumns({k: F.lit(v) for k, v in paths.items()})


def first_result(tasks: DataFrame, collections: list[DataFrame], key: str = "task_id") -> DataFrame:
    """Each task with its result from the first collection that has one; tasks without any keep nulls."""
    numbered = [c.withColumn("_k", F.lit(k)) for k, c in enumerate(collections)]
    all_ = numbered[0]
    for c in numbered[1:]:
        all_ = all_.unionByName(c, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in (key, "_k")]
    first = all_.groupBy(key).agg(F.min_by(F.struct(*rest), "_k").alias("_r"))
    return tasks.join(first, key, "left").select(*tasks.columns, *(F.col(f"_r.{c}").alias(c) for c in rest if c not in tasks.columns))
