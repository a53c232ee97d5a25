"""Queries over runs: gates and budgets, probes, archives, tables of checkpoints, spans, samples and streams."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import functions as F

from tallyloom.operators import advantages as adv
from tallyloom.operators import checkpoints as cp
from tallyloom.operators import metrics, sampling, windows
from tallyloom.operators.plugins import apply_summaries
from tallyloom.plans.base import query, rounded
from tallyloom.sources import files
from tallyloom.sources import yaml_rollouts as yaml_files
from tallyloom.sources.tables import CHECKPOINTS_SQL, ROLLOUTS_SQL, checkpoints, rollouts, table
from tallyloom.storage import scratch
from tallyloom.streaming import batches

_U = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


# --- batches ------------------------------------------------------------------------------------


@query("SELECT CAST(iteration AS INTEGER) AS iteration, CAST(iteration % 3 AS INTEGER) AS attempt, CASE WHEN iteration % 4 = 0 THEN 'aborted' WHEN iteration % 4 = 1 THEN 'pending' ELSE 'committed' END AS status, iteration % 4 = 0 AS restart, iteration % 4 > 1 AND iteration <> 3 AS orphan FROM range(6) t(iteration)")
def gate_states(spark, sf_dir):
    gate = batches.Gate(spark, scratch(spark, "gate"))
    for i in range(6):
        for _ in range(i % 3 + 1):
            gate.begin(i, 10)
        if i % 4 == 0:
            gate.abort(i, batches.HARD_DEAD[0])
        elif i % 4 > 1:
            gate.commit(i, 10)
    now = gate.current()
    lost = batches.orphans(now, spark.createDataFrame([(3,)], "iteration int")).select("iteration", F.lit(True).alias("orphan"))
    return now.join(lost, "iteration", "left").select("iteration", "attempt", "status", batches.hard_dead(F.col("status"), F.col("reason")).alias("restart"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS attempt FROM events")
def attempt_numbers(spark, sf_dir):
    return batches.attempts(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT batch, expected, found FROM (SELECT event_id // 10 AS batch, CAST(10 AS BIGINT) AS expected, count(*) FILTER (WHERE value <= 40) AS found FROM events GROUP BY ALL) WHERE expected <> found")
def incomplete_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("batch"), "value")
    return batches.complete_batches(rows.select("batch").distinct().withColumn("n", F.lit(10)), rows.filter("value <= 40"), ["batch"], "n")


@query("""WITH e AS (SELECT event_id // 50 AS iteration, event_id // 5 AS rollout, event_id FROM events WHERE value > 15), m AS (SELECT *, row_number() OVER (PARTITION BY rollout ORDER BY event_id) AS k, row_number() OVER (PARTITION BY iteration ORDER BY event_id) AS i FROM e),
f AS (SELECT *, min(event_id) FILTER (WHERE k > 2 OR i > 15) OVER (PARTITION BY iteration) AS first_ FROM m) SELECT iteration, rollout, event_id, CASE WHEN event_id = first_ THEN 'abort' ELSE 'retry' END AS outcome FROM f WHERE first_ IS NULL OR event_id <= first_""")
def iteration_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("iteration"), F.floor(F.col("event_id") / 5).alias("rollout"), "event_id", (F.col("value") > 15).alias("soft_dead"))
    return batches.iteration_budget(e, "iteration", "rollout", "event_id", 2, 15).drop("soft_dead")


@query("""WITH r AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS scenario, event_id % 10 = 3 AS cancelled FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY event_id) AS k, row_number() OVER (ORDER BY event_id) AS n FROM r WHERE NOT cancelled),
s AS (SELECT max(event_id) AS stop_at FROM k WHERE n = 18 OR k = 4) SELECT scenario, count(*) FILTER (WHERE NOT cancelled AND event_id <= stop_at) AS n_collected, count(*) FILTER (WHERE cancelled OR event_id > stop_at) AS n_dropped FROM r, s GROUP BY scenario""")
def late_rollouts(spark, sf_dir):
    results = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("scenario"), (F.col("event_id") % 10 == 3).alias("cancelled"))
    return batches.after_stop(results, batches.early_stop(results, 4, 6, "event_id", 0.75, 0.75), "scenario", "event_id")


@query("""WITH s AS (SELECT user_id, event_id, 5 + event_id % 4 AS wanted, 1 + event_id % 2 AS made FROM events), t AS (SELECT *, wanted + sum(made) OVER (PARTITION BY user_id ORDER BY event_id) - made AS lvl FROM s),
u AS (SELECT *, max(lvl) OVER w AS most, max(lvl) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CAST(greatest(most - coalesce(before, 0), 0) AS BIGINT) AS requested FROM u""")
def demand(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4 + 5).alias("wanted"), (F.col("event_id") % 2 + 1).alias("made"))
    return batches.requests(steps, "user_id", "event_id", "wanted", "made").select("user_id", "event_id", "requested")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg('t' || turn, '' ORDER BY turn) AS text, string_agg(turn || ',' || (turn + 1), ',' ORDER BY turn) AS tokens, round(sum(-turn / 4.0), 6) + 0.0::DOUBLE AS log_prob, conv_id % 2 = 0 AS stopped_by_limit FROM c GROUP BY conv_id""")
def streamed_texts(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.max("turn").over(_by("conv_id")).alias("last"))
    one = F.struct(
        F.concat(F.lit("t"), "turn").alias("text"), F.when(F.col("turn") == F.col("last"), F.when(F.col("conv_id") % 2 == 0, "length").otherwise("stop")).alias("finish_reason"),
        F.struct(F.array(F.concat(F.lit("token_id:"), "turn"), F.concat(F.lit("token_id:"), F.col("turn") + 1)).alias("tokens"), F.array(-F.col("turn") / 4.0, F.lit(0.0)).alias("token_logprobs")).alias("logprobs"))
    chunks = m.select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct(F.array(one).alias("choices"))), F.lit("\n\n")).alias("value"))
    ends = m.filter("turn = last").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("data: [DONE]\n\n").alias("value"))
    after = ends.withColumns({"turn": F.col("turn") + 1, "value": F.lit("data: {}")})
    found = batches.streamed_texts(chunks.union(ends).union(after), "conv_id", "turn")
    return found.select("conv_id", "text", F.array_join("tokens", ",").alias("tokens"), (F.round(F.aggregate("log_probs", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("log_prob"), "stopped_by_limit")


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


# --- probes and archives ------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey AS i, CAST(c_custkey * 37 % 900 AS INTEGER) AS m, CAST(c_custkey % 11 AS INTEGER) AS u FROM customer WHERE c_custkey % 5 <> 0)
SELECT CAST(c_custkey AS INTEGER) AS index, coalesce(m <= 500 AND u <= 5, false) AS idle, CASE WHEN m IS NULL THEN 'gpu' || c_custkey || '=missing' WHEN m > 500 OR u > 5 THEN 'gpu' || i || '=mem' || m || 'MiB/util' || u || '%' END AS busy FROM customer LEFT JOIN s ON i = c_custkey""")
def idle_devices(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("index"))
    i = F.col("index")
    lines = c.filter(i % 5 != 0).select(F.concat_ws(", ", i, i * 37 % 900, i % 11).alias("value")).union(c.select(F.lit("N/A, broken").alias("value")).limit(1))
    return files.idle_devices(c, files.gpu_status(lines), 500, 5)


@query("""SELECT 'rollout' AS kind, CAST(doc_id % 2 AS INTEGER) AS rank, CAST(doc_id // 2 % 5 AS INTEGER) AS scenario, CAST(doc_id // 10 AS INTEGER) AS rollout, doc_id, CAST((doc_id % 2 * 5 + doc_id // 2 % 5) * (max(doc_id // 10) OVER () + 1) + doc_id // 10 AS INTEGER) AS place, true AS back FROM documents""")
def archive_index(spark, sf_dir):
    path, docs = scratch(spark, "archives"), table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    member = F.format_string("rollout.r%d.%d.%d.yaml", i % 2, F.floor(i / 2) % 5, F.floor(i / 10))
    files.write_archives(docs.select((i % 2).cast("int").alias("rank"), member.alias("member"), i.cast("string").alias("text")), path)
    members = files.rollout_members(files.archive_members(spark, path))
    shaped = members.crossJoin(F.broadcast(files.rollout_shape(members)))
    place = files.linear_index(F.col("rank"), F.col("scenario"), F.col("rollout"), F.col("num_scenarios"), F.col("num_rollouts"))
    back = files.from_linear(F.col("place"), F.col("num_scenarios"), F.col("num_rollouts"))
    same = back == F.struct("rank", "scenario", "rollout")
    return shaped.withColumn("place", place).select("kind", "rank", "scenario", "rollout", F.col("text").cast("long").alias("doc_id"), "place", same.alias("back"))


@query("SELECT split, n FROM (SELECT 'a' AS split, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'b', count(DISTINCT lang) FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'c', NULL)")
def split_sizes(spark, sf_dir):
    folder, docs = scratch(spark, "counts"), table(spark, sf_dir, "documents")
    files.write_split(docs.select(F.col("source").alias("task_id")).filter("task_id IS NOT NULL").distinct(), f"{folder}/a.txt")
    files.write_split(docs.select(F.col("lang").alias("task_id")).filter("task_id IS NOT NULL").distinct(), f"{folder}/b.txt")
    return files.split_counts(spark, folder, ["a", "b", "c"])


@query("SELECT 'p' || p_partkey AS task_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 = 0")
def install_collisions(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("task_id"), "p_partkey")
    return files.collisions(ids.filter("p_partkey % 3 = 0"), ids.filter("p_partkey % 4 = 0"))


@query("SELECT count(*) AS iterations_completed, CAST(sum(user_id) AS BIGINT) AS output_tokens_generated, CAST(max(event_id) AS BIGINT) AS rollouts_generated, CAST(0 AS BIGINT) AS global_step FROM events")
def trainer_state(spark, sf_dir):
    path = scratch(spark, "state")
    state = table(spark, sf_dir, "events").agg(F.count("*").alias("iterations_completed"), F.sum("user_id").alias("output_tokens_generated"), F.max("event_id").alias("rollouts_generated"), F.lit(0).cast("long").alias("global_step"))
    files.write_state(state, path)
    return files.read_state(spark, path)


@query("SELECT CAST(max(o_custkey) AS INTEGER) AS iteration, 'checkpoint-' || max(o_custkey) AS folder FROM orders WHERE o_custkey % 3 = 0")
def last_complete_checkpoint(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_custkey").cast("string")).alias("folder"), F.when(F.col("o_custkey") % 3 == 0, "done.txt").otherwise("trainer_state.json").alias("name"))
    return files.last_checkpoint(files.complete_checkpoints(names)).select("iteration", "folder")


@query("SELECT CAST(0.5 AS DOUBLE) AS \"TGC\", CAST(count(*) AS DOUBLE) AS \"SGC\", CAST(NULL AS DOUBLE) AS \"TGC_1\" FROM orders")
def result_lines(spark, sf_dir):
    path = scratch(spark, "results")
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("s")).withColumns({"t": F.lit(0.25), "k": F.lit(1)})
    for k, tgc in enumerate((0.25, 0.5)):
        line = n.withColumn("t", F.lit(tgc)).select(F.concat(F.lit(f"2024-01-0{k + 1} "), files.result_line({"TGC": "t", "SGC": "s"})).alias("value"))
        files.append_line(line, path)
    return files.read_result_line(spark.read.text(path), ["TGC", "SGC", "TGC_1"], "value")


# --- checkpoints and metrics --------------------------------------------------------------------

_ROWS = 'SELECT split, experiment AS experiment_name, CAST(substr(experiment, 1, 1) AS INTEGER) * 5 AS checkpoint_iteration, "TGC", CASE WHEN invalid_api_hits % 2 = 0 THEN 0.0::DOUBLE ELSE "SGC" END AS "SGC", 0.5::DOUBLE AS average_partial_pass_rate, invalid_api_hits, execution_failed_count FROM v_checkpoints'


def _checkpoint_rows(spark, sf_dir):
    rows = checkpoints(spark, sf_dir).withColumnRenamed("experiment", "experiment_name")
    return rows.withColumns({"checkpoint_iteration": F.substring("experiment_name", 1, 1).cast("int") * 5, "SGC": F.when(F.col("invalid_api_hits") % 2 == 0, 0.0).otherwise(F.col("SGC")), "average_partial_pass_rate": F.lit(0.5)})


@query(f"""WITH {CHECKPOINTS_SQL} SELECT split, experiment_name, checkpoint_iteration FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY coalesce(nullif("SGC", 0), -1) DESC, -coalesce(nullif(CAST(invalid_api_hits AS DOUBLE), 0), 1e18) DESC, CAST(checkpoint_iteration AS VARCHAR), experiment_name) AS r FROM ({_ROWS})) WHERE r = 1""")
def best_of_split(spark, sf_dir):
    rows = _checkpoint_rows(spark, sf_dir).withColumn("TGC", F.lit(None).cast("double"))
    return cp.best_of_split(rows).select("split", "experiment_name", "checkpoint_iteration")


@query(f"""WITH {CHECKPOINTS_SQL} SELECT split, experiment_name, CAST(row_number() OVER (PARTITION BY split ORDER BY CAST(checkpoint_iteration AS VARCHAR), experiment_name) AS INTEGER) AS place FROM ({_ROWS})""")
def table_order(spark, sf_dir):
    rows = cp.in_table_order(_checkpoint_rows(spark, sf_dir))
    listed = rows.groupBy("split").agg(F.collect_list("experiment_name").alias("names"))
    return listed.select("split", F.posexplode("names").alias("place", "experiment_name")).withColumn("place", F.col("place") + 1)


@query(f"WITH {ROLLOUTS_SQL} SELECT CAST(sum(num_tests) AS BIGINT) AS output_tokens_per_iteration, round(sum(num_tests) / 12.5, 6) AS output_tokens_per_sec, round(count(*) / 12.5, 6) AS rollouts_per_sec FROM v_rollouts")
def evaluation_throughput(spark, sf_dir):
    found = metrics.throughput(rollouts(spark, sf_dir).withColumn("n_output", F.col("num_tests")), 12.5)
    return found.select("output_tokens_per_iteration", *rounded("output_tokens_per_sec", "rollouts_per_sec"))


@query(f"WITH {ROLLOUTS_SQL} SELECT scenario, round(sum(num_tests) / count(*), 6) AS tokens_per_rollout, round(sum(ret) / count(*), 6) AS return_per_rollout, count(*) FILTER (WHERE cancelled) AS n_cancelled FROM v_rollouts GROUP BY scenario")
def iteration_averages(spark, sf_dir):
    found = metrics.averages(rollouts(spark, sf_dir), ["scenario"], {"tokens_per_rollout": "num_tests", "return_per_rollout": "ret"})
    return found.select("scenario", *rounded("tokens_per_rollout", "return_per_rollout"), "n_cancelled")


@query(f"WITH {ROLLOUTS_SQL} SELECT count(*) FILTER (WHERE success) AS n_successes, count(*) AS n_tasks FROM v_rollouts WHERE difficulty = 2")
def difficulty_filter(spark, sf_dir):
    return metrics.summary(metrics.of_difficulty(rollouts(spark, sf_dir), 2)).select("n_successes", "n_tasks")


@query(f"WITH {ROLLOUTS_SQL} SELECT 'by_source' AS summary, dataset_name AS name, round(avg(ret), 6) AS value FROM v_rollouts GROUP BY dataset_name UNION ALL SELECT 'overall', 'tgc', round(avg(CAST(success AS DOUBLE)), 6) FROM v_rollouts")
def plugged_summaries(spark, sf_dir):
    by_source = lambda df: df.groupBy(F.col("dataset_name").alias("name")).agg(F.avg("ret").alias("value"))
    overall = lambda df: metrics.summary(df).select(F.lit("tgc").alias("name"), F.col("tgc").alias("value"))
    return apply_summaries(rollouts(spark, sf_dir), {"by_source": by_source, "overall": overall}).select("summary", "name", *rounded("value"))


@query("SELECT user_id AS k, round(avg(value / 1048576), 9) AS mb_peak, CASE WHEN bool_and(event_id % 97 <> 0) THEN round(avg(value / 1048576 / nullif(event_id % 97, 0)), 9) END AS mb_per_item FROM events GROUP BY user_id")
def peak_memory(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "value", (F.col("event_id") % 97).alias("items"))
    found = metrics.peak_memory(e, "k", "value", "items")
    return found.select("k", F.round("mb_peak", 9).alias("mb_peak"), F.round("mb_per_item", 9).alias("mb_per_item"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS span, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber // 2 END AS parent, l_quantity AS seconds, l_returnflag AS name, l_linenumber AS n, (l_orderkey * 10 + l_linenumber, l_quantity, l_partkey, l_extendedprice) AS at_ FROM lineitem),
x AS (SELECT s.*, s.seconds - coalesce(c.i, 0) AS ex, row_number() OVER (PARTITION BY name ORDER BY at_) AS a, row_number() OVER (PARTITION BY name ORDER BY at_ DESC) AS b FROM s LEFT JOIN (SELECT parent AS p, sum(seconds) AS i FROM s GROUP BY parent) c ON s.span = c.p)
SELECT name, round(avg(seconds) FILTER (WHERE a >= 3 AND b <= 100), 6) AS inclusive, round(avg(ex) FILTER (WHERE a >= 3 AND b <= 100), 6) AS exclusive, round(sum(n) FILTER (WHERE a >= 3 AND b <= 100) / sum(seconds) FILTER (WHERE a >= 3 AND b <= 100), 6) AS throughput, round(sum(seconds), 4) AS total_time FROM x GROUP BY name""")
def span_summary(spark, sf_dir):
    n, key = F.col("l_linenumber"), F.col("l_orderkey") * 10
    spans = table(spark, sf_dir, "lineitem").select((key + n).alias("span"), F.when(n > 1, key + F.floor(n / 2)).alias("parent"), F.col("l_quantity").alias("seconds"), F.col("l_returnflag").alias("name"), n.alias("count"), F.struct(key + n, "l_quantity", "l_partkey", "l_extendedprice").alias("at"))
    return windows.span_summary(spans, order="at").select("name", *rounded("inclusive", "exclusive", "throughput"), F.round("total_time", 4).alias("total_time"))


# --- ranges, names, samples ---------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT o_custkey AS k, o_orderkey // 50 AS x FROM orders), i AS (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM e), r AS (SELECT k, min(x) AS a, max(x) AS b, count(*) AS n FROM i GROUP BY k, g)
SELECT k, CASE WHEN sum(n) = 1 THEN CAST(min(a) AS VARCHAR) ELSE '[' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) || ']' END AS text FROM r GROUP BY k""")
def range_text(spark, sf_dir):
    numbers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 50).alias("x")).distinct()
    return windows.range_text(numbers, "k", "x")


@query("""WITH e AS (SELECT DISTINCT p_partkey % 7 AS k, p_partkey // 40 AS x FROM part), i AS (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM e), r AS (SELECT k, min(x) AS a, max(x) AS b, count(*) AS n FROM i GROUP BY k, g)
SELECT k, 'model.layers.' || CASE WHEN sum(n) = 1 THEN CAST(min(a) AS VARCHAR) ELSE '[' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) || ']' END || '.' || w AS names FROM r, (SELECT unnest(['attn', 'mlp.up']) AS w) GROUP BY k, w UNION ALL SELECT k, 'head' FROM e GROUP BY k""")
def grouped_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("k"), F.floor(F.col("p_partkey") / 40).cast("string").alias("x"))
    names = p.select("k", F.explode(F.array(F.concat(F.lit("model.layers."), "x", F.lit(".attn")), F.concat(F.lit("model.layers."), "x", F.lit(".mlp.up")), F.lit("head"))).alias("name"))
    return windows.grouped_names(names, "k", "name")


@query(f"SELECT c_custkey, CAST(row_number() OVER (ORDER BY {_U.format("c_custkey || '|11'")}, c_custkey) - 1 AS BIGINT) AS place FROM customer")
def permutation(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 11)


@query(f"SELECT c_custkey, place, false AS short FROM (SELECT c_custkey, CAST(row_number() OVER (ORDER BY {_U.format("c_custkey || '|20'")}, c_custkey) - 1 AS BIGINT) AS place FROM customer) WHERE place < 64")
def small_split(spark, sf_dir):
    return sampling.small_split(table(spark, sf_dir, "customer"), "c_custkey", 64, 20)


@query(f"""WITH {ROLLOUTS_SQL}, g AS (SELECT *, count(*) OVER w AS n, sum(ret) OVER w AS s, stddev_pop(ret) OVER w AS d FROM (SELECT * REPLACE (CASE WHEN task % 5 = 0 THEN 0.5::DOUBLE ELSE ret END AS ret) FROM v_rollouts) WINDOW w AS (PARTITION BY task))
SELECT task, rollout, round(round((ret - (s - ret) / (n - 1)) / greatest(d, 1e-7), 9), 5) + 0.0::DOUBLE AS advantage FROM g WHERE n >= 2 AND (task % 5 = 0 OR d > 1e-9)""")
def advantage_without_spread(spark, sf_dir):
    """Groups of equal returns have advantage 0: their deviation is taken as 1e-7."""
    live = rollouts(spark, sf_dir).withColumn("ret", F.when(F.col("task") % 5 == 0, 0.5).otherwise(F.col("ret")))
    spread = live.groupBy("task").agg(F.stddev_pop("ret").alias("d")).filter("d > 1e-9 OR task % 5 = 0").select("task")
    found = adv.advantages(live, ["task"], normalise=True).join(spread, "task", "left_semi")
    return found.select("task", "rollout", (F.round(F.round("advantage", 9), 5) + 0.0).alias("advantage"))


# --- YAML and streams ---------------------------------------------------------------------------


_YAML_SQL = """SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role || '=' || text, '|' ORDER BY turn) AS said, '2024-01-0' || (conv_id % 9 + 1) AS today, false AS cancelled, CAST(0 AS INTEGER) AS num_prompt_messages, CAST(CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE -1 END AS INTEGER) AS n_execution_failed FROM conversations GROUP BY conv_id"""


def yaml_rollouts(spark, sf_dir):
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)  # noqa: E731  a JSON string and a bracket
    date = F.concat(F.lit("2024-01-0"), F.col("conv_id") % 9 + 1)
    line = F.concat(F.lit("- !!python/object:agents.Message\n  role: "), "role", F.lit("\n  today_date: "), date, F.lit("\n  content: "), F.regexp_replace(quoted(F.col("text")), r"\]$", ""), F.lit("\n"))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    whole = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "").alias("body"))
    known = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\n  n_execution_failed: "), F.col("conv_id").cast("string"))).otherwise("")
    text = F.concat(F.lit("messages:\n"), "body", F.lit("ret: 0.5\nappworld_rollout_data:\n  task: !!python/object:agents.Task\n    task_id: '"), F.col("conv_id").cast("string"), F.lit("'"), known, F.lit("\n"))
    rollouts_ = whole.select(yaml_files.parsed(text).alias("r"))
    e = yaml_files.episodes(rollouts_, "r", "x")
    said = F.array_join(F.transform("chat_history", lambda x: F.concat_ws("=", x["role"], x["content"])), "|")
    return e.select("task_id", F.size("chat_history").alias("n_messages"), said.alias("said"), F.col("chat_history")[0]["today_date"].alias("today"), "cancelled", "num_prompt_messages", "n_execution_failed")


if find_spec("yaml"):  # a package that not every machine has
    query(_YAML_SQL)(yaml_rollouts)


@query("SELECT event_id, CASE WHEN user_id % 100 >= 85 THEN 'hard_dead' WHEN value >= 65 THEN 'hard_dead' WHEN value >= 45 THEN 'soft_dead' WHEN value >= 35 THEN 'draining' WHEN value >= 25 THEN 'recycle_after_task' ELSE 'healthy' END AS state FROM events")
def health_stream(spark, sf_dir):
    path, schema = scratch(spark, "health"), table(spark, sf_dir, "events").schema
    gauges = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    states = gauges.select("event_id", cp.health(F.col("value"), F.col("user_id") % 100).alias("state"))
    batches.commit_batches(states, path, scratch(spark, "health-state")).awaitTermination()
    return spark.read.parquet(path).select("event_id", "state")
