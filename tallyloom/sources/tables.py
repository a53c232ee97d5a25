"""The tables of a folder, and views of them that stand for rollouts, tokens, checkpoints and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order that has lines: its lines are the tests of a rollout."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rollout")).agg(
        F.count("*").alias("num_tests"), F.count_if(F.col("l_returnflag") == "N").alias("passes"), F.count_if(F.col("l_linestatus") == "O").alias("n_exec_failed")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rollout"), F.col("o_custkey").alias("task"), (F.col("o_orderstatus") == "P").alias("cancelled"))
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("dataset_name"), F.col("c_nationkey").alias("scenario"))
    return lines.join(orders, "rollout").join(tasks, "task").select(
        "task", "rollout", "scenario", "dataset_name", (F.col("task") % 3 + 1).cast("int").alias("difficulty"), "num_tests", "passes", "n_exec_failed",
        (F.col("passes") / F.col("num_tests")).alias("ret"), (F.col("passes") == F.col("num_tests")).alias("success"), "cancelled",
    )


#: The same view for SQL engines.
ROLLOUTS_SQL = """v_rollouts AS (
  SELECT o_custkey AS task, o_orderkey AS rollout, c_nationkey AS scenario, c_mktsegment AS dataset_name,
         CAST(o_custkey % 3 + 1 AS INTEGER) AS difficulty, num_tests, passes, n_exec_failed,
         CAST(passes AS DOUBLE) / num_tests AS ret, passes = num_tests AS success, o_orderstatus = 'P' AS cancelled
  FROM (SELECT l_orderkey, count(*) AS num_tests, count(*) FILTER (WHERE l_returnflag = 'N') AS passes,
               count(*) FILTER (WHERE l_linestatus = 'O') AS n_exec_failed FROM lineitem GROUP BY l_orderkey) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new log-probabilities and the output mask of a rollout, by position."""
    e = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("rollout"), F.col("label").alias("scenario"), e.alias("old_lp"), F.transform(e, lambda x: x * 1.1).alias("new_lp"),
        F.transform("embedding", lambda x, i: i >= 16).alias("is_output"),
    )


#: One row for each token: new minus old log-probability.
TOKENS_SQL = """v_tokens AS (
  SELECT vec_id AS rollout, label AS scenario, CAST(i AS INTEGER) AS i, -abs(CAST(x AS DOUBLE)) AS old_lp, -abs(CAST(x AS DOUBLE)) * 1.1 AS new_lp, i > 16 AS is_output
  FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of a base model and its checkpoints: orders by priority (checkpoint) and status (split)."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("experiment")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("TGC"), F.round(F.avg(F.col("o_custkey") % 7), 6).alias("SGC"), F.count("*").alias("execution_failed_count"),
        F.count_if(F.col("o_custkey") % 11 == 0).alias("invalid_api_hits"),
    )


CHECKPOINTS_SQL = """v_checkpoints AS (
  SELECT o_orderstatus AS split, o_orderpriority AS experiment, round(avg(o_totalprice), 6) AS "TGC", round(avg(o_custkey % 7), 6) AS "SGC",
         count(*) AS execution_failed_count, count(*) FILTER (WHERE o_custkey % 11 = 0) AS invalid_api_hits
  FROM orders GROUP BY ALL)"""


#: What is said in a turn of the episodes below, in SQL that Spark and other engines read alike.
_SAID = """CASE event_id % 6
 WHEN 0 THEN 'I assume so.' || chr(10) || '```python' || chr(10) || 'print(apis.api_docs.show_api_descriptions(app_name=' || chr(39) || event_type || chr(39) || '))' || chr(10) || '```'
 WHEN 1 THEN '```py' || chr(10) || 'apis.api_docs.show_api_doc(app_name=' || chr(34) || event_type || chr(34) || ', api_name=' || chr(34) || 'get_' || CAST(event_id % 3 AS STRING) || chr(34) || ')' || chr(10) || '``` then ```PYTHON' || chr(10) || 'apis.' || event_type || '.get_' || CAST(event_id % 3 AS STRING) || ' (a=1)' || chr(10) || ' ```'
 WHEN 2 THEN 'A dummy: ```python x = 1 ``` and' || chr(10) || '```python' || chr(10) || 'apis.' || event_type || '.get_0(1)' || chr(10) || 'apis.' || event_type || '.get_2()' || chr(10)
 WHEN 3 THEN 'I cannot guess; instead assume a placeholder'
 ELSE '```python' || chr(10) || 'apis.' || event_type || '.get_' || CAST(event_id % 3 AS STRING) || '()' || chr(10) || 'apis.view.get_0()' || chr(10) || '```' END"""
_SEEN = "CASE WHEN value > 20 THEN 'Execution failed. ' || chr(10) || 'AttributeError: no apis.' || event_type || ' has no attribute x' ELSE 'ok' END"
_TASK = "event_id - event_id % 8"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode documents of eight turns each, made of events; messages, verdicts and counters vary with the ids."""
    each = table(spark, sf_dir, "events").select("event_id", F.expr(_TASK).alias("t"), F.expr(_SAID).alias("said"), F.expr(_SEEN).alias("seen"))
    history = F.array_sort(F.collect_list(F.struct("event_id", "said", "seen")))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    told = F.flatten(F.transform(history, lambda m: F.array(message("assistant", m["said"]), message("ipython", m["seen"]))))
    prompt = F.array(message("system", F.lit("Invalid API calls fail.")), message("user", F.lit("Do it, assuming nothing.")))
    grouped = each.groupBy("t").agg(told.alias("told"))
    n = F.col("t") / 8
    tests = F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")), lambda x: F.struct(x.cast("string").alias("requirement")))
    return grouped.select(
        F.concat(F.lit("checkpoint-"), (n % 4 * 10).cast("int").cast("string")).alias("experiment"), F.col("t").cast("string").alias("task_id"),
        F.when(n % 10 == 7, prompt).otherwise(F.concat(prompt, "told")).alias("chat_history"),
        F.struct((n % 5 == 0).alias("success"), (n % 3 + 1).cast("int").alias("difficulty"), (n % 4).cast("int").alias("num_tests"), tests.alias("passes"), F.when(n % 7 != 0, (n % 9).cast("int")).alias("num_interactions")).alias("eval_result"),
        F.lit(2).alias("num_prompt_messages"), F.when(n % 3 != 0, (n % 3).cast("int")).alias("n_execution_failed"), (n % 2).cast("int").alias("n_no_code_found"), (n % 11 == 0).alias("cancelled"),
    )


#: The same episodes (v_episodes) and their messages (v_messages) for SQL engines.
EPISODES_SQL = f"""v_turns AS (SELECT event_id, {_TASK} AS t, ({_TASK}) // 8 AS n, {_SAID} AS said, {_SEEN} AS seen, row_number() OVER (PARTITION BY {_TASK} ORDER BY event_id) - 1 AS k FROM events),
v_episodes AS (SELECT 'checkpoint-' || CAST(n % 4 * 10 AS VARCHAR) AS experiment, CAST(t AS VARCHAR) AS task_id, n, n % 5 = 0 AS success, CAST(n % 3 + 1 AS INTEGER) AS difficulty, CAST(n % 4 AS INTEGER) AS num_tests, n % 3 + 1 AS passes,
  CASE WHEN n % 7 <> 0 THEN CAST(n % 9 AS INTEGER) END AS num_interactions, CAST(coalesce(CASE WHEN n % 3 <> 0 THEN n % 3 END, 0) AS BIGINT) AS n_execution_failed, CAST(n % 2 AS BIGINT) AS n_no_code_found, n % 11 = 0 AS cancelled FROM (SELECT DISTINCT t, n FROM v_turns)),
v_messages AS (SELECT experiment, task_id, msg_idx, role, content FROM v_episodes JOIN (
  SELECT DISTINCT CAST(t AS VARCHAR) AS task_id, 0 AS msg_idx, 'system' AS role, 'Invalid API calls fail.' AS content FROM v_turns
  UNION ALL SELECT DISTINCT CAST(t AS VARCHAR), 1, 'user', 'Do it, assuming nothing.' FROM v_turns
  UNION ALL SELECT CAST(t AS VARCHAR), 2 + 2 * k, 'assistant', said FROM v_turns WHERE n % 10 <> 7
  UNION ALL SELECT CAST(t AS VARCHAR), 3 + 2 * k, 'ipython', seen FROM v_turns WHERE n % 10 <> 7) USING (task_id))"""
