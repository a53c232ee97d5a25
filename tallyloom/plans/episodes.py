"""Queries over episode documents: values, turns, code, calls, behaviour rows and joins of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import behaviour as bh
from tallyloom.operators import metrics
from tallyloom.operators import transcripts as tr
from tallyloom.plans.base import query, rounded
from tallyloom.sources import files
from tallyloom.sources.tables import EPISODES_SQL, ROLLOUTS_SQL, episodes, rollouts, table

_HITS = " + ".join(f"len(regexp_extract_all(said, '(?i){p}'))" for p in tr.INVALID_API)
_COUNT = "CAST(len(regexp_extract_all({}, '{}')) AS BIGINT)"
_WORDS = ", ".join(f"{_COUNT.format('said', p.replace(chr(39), chr(39) * 2))} AS {n}" for n, p in (("assumption_words", tr.ASSUMPTION), ("assumption_words_extended", tr.ASSUMPTION_EXTENDED), ("dummy_words", tr.DUMMY), ("dummy_words_extended", tr.DUMMY_EXTENDED)))
_VALUES = f"""WITH {EPISODES_SQL}, x AS (SELECT experiment, task_id, string_agg(role || chr(10) || content, chr(10) ORDER BY msg_idx) AS said FROM v_messages GROUP BY ALL),
v AS (SELECT experiment, task_id, success, CASE WHEN num_tests > 0 THEN passes / num_tests ELSE 0 END AS pass_rate, difficulty, num_interactions, n_execution_failed, n_no_code_found, cancelled, CAST({_HITS} AS BIGINT) AS invalid_api_hits, {_WORDS}
  FROM v_episodes JOIN x USING (experiment, task_id))"""
_BLOCKS = r"""t AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY task_id ORDER BY msg_idx ROWS UNBOUNDED PRECEDING) AS turn_no FROM v_messages WHERE msg_idx >= 2),
p AS (SELECT experiment, task_id, turn_no, max(content) FILTER (WHERE role = 'assistant') AS said, coalesce(arg_min(content, msg_idx) FILTER (WHERE role IN ('user', 'ipython')), '') AS observation FROM t WHERE turn_no > 0 GROUP BY ALL),
r AS (SELECT *, regexp_extract_all(said, '(?is)```(?:python|py)\s*\n?(.*?)```', 1) AS closed, regexp_extract(regexp_replace(said, '(?is)\A(?:.*?```(?:python|py)\s*\n?.*?```)+', ''), '(?is)```(?:python|py)\s*\n?(.*)$', 1) AS tail FROM p),
b AS (SELECT experiment, task_id, turn_no, said, observation, contains(observation, 'Execution failed.') AS failed, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN CASE WHEN trim(tail) <> '' THEN list_append(closed, tail) ELSE closed END] AS blocks FROM r),
c AS (SELECT experiment, task_id, turn_no, failed, block_no, unnest(regexp_extract_all(code, '\bapis\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(([^)]*)', 1)) AS app, unnest(regexp_extract_all(code, '\bapis\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(([^)]*)', 2)) AS api,
    unnest(regexp_extract_all(code, '\bapis\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(([^)]*)', 3)) AS args, unnest(range(len(regexp_extract_all(code, '\bapis\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\(([^)]*)', 3)))) AS seq
  FROM (SELECT *, unnest(blocks) AS code, unnest(range(len(blocks))) AS block_no FROM b)),
e AS (SELECT experiment, task_id, turn_no, failed, turn_no * 1000000 + block_no * 1000 + seq AS pos, CASE WHEN app <> 'api_docs' THEN 'call' WHEN api = 'show_api_descriptions' THEN 'description' ELSE 'doc' END AS kind,
    CASE WHEN app <> 'api_docs' THEN app ELSE regexp_extract(args, 'app_name\s*=\s*[''"]([^''"]+)[''"]', 1) END AS app, CASE WHEN app <> 'api_docs' THEN api ELSE regexp_extract(args, 'api_name\s*=\s*[''"]([^''"]+)[''"]', 1) END AS api FROM c)"""


@query(_VALUES + " SELECT * REPLACE (round(pass_rate, 6) + 0.0::DOUBLE AS pass_rate) FROM v")
def episode_values(spark, sf_dir):
    found = bh.episode_values(episodes(spark, sf_dir))
    return found.withColumn("pass_rate", rounded("pass_rate")[0])


@query(_VALUES + """ SELECT experiment, count(*) AS episodes, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(pass_rate), 6) AS avg_subtest_pass_rate, round(coalesce(avg(num_interactions), 0), 6) AS avg_num_interactions,
CAST(sum(n_execution_failed) AS BIGINT) AS execution_failed_total, round(avg(CAST(n_execution_failed > 0 AS DOUBLE)), 6) AS execution_failed_task_rate, CAST(sum(n_no_code_found) AS BIGINT) AS no_code_found_total, round(avg(CAST(n_no_code_found > 0 AS DOUBLE)), 6) AS no_code_found_task_rate,
CAST(sum(invalid_api_hits) AS BIGINT) AS invalid_api_regex_hits, round(avg(CAST(invalid_api_hits > 0 AS DOUBLE)), 6) AS invalid_api_task_rate, count(*) FILTER (WHERE cancelled) AS cancelled_total FROM v GROUP BY experiment""")
def experiment_summary(spark, sf_dir):
    found = bh.summary(bh.episode_values(episodes(spark, sf_dir)))
    return found.withColumns({c: rounded(c)[0] for c, kind in found.dtypes if kind == "double"})


@query(f"WITH {EPISODES_SQL}, {_BLOCKS} SELECT experiment, task_id, turn_no, observation, failed, array_to_string(blocks, '|') AS code, CAST(len(blocks) AS INTEGER) AS n_blocks FROM b")
def turn_code(spark, sf_dir):
    said = bh.turns(episodes(spark, sf_dir))
    return said.select("experiment", "task_id", "turn_no", "observation", "failed", F.array_join("blocks", "|").alias("code"), F.size("blocks").alias("n_blocks"))


@query(f"WITH {EPISODES_SQL}, {_BLOCKS} SELECT experiment, task_id, CAST(pos AS BIGINT) AS pos, kind, app, api FROM e")
def call_events(spark, sf_dir):
    pos = F.col("pos.turn_no") * 1000000 + F.col("pos.block_no") * 1000 + F.col("pos.at")
    return bh.events(bh.turns(episodes(spark, sf_dir))).withColumn("pos", pos.cast("long"))


@query(f"WITH {EPISODES_SQL}, {_BLOCKS} SELECT task_id, count(*) AS n, count(DISTINCT app || '.' || api) AS n_different, string_agg(app || '.' || api, ',' ORDER BY pos) AS calls FROM e WHERE kind = 'call' GROUP BY task_id")
def api_calls(spark, sf_dir):
    said = bh.turns(episodes(spark, sf_dir)).filter("size(calls) > 0")
    calls = said.groupBy("task_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "calls"))), lambda x: x["calls"])).alias("c"))
    return calls.select("task_id", F.size("c").cast("long").alias("n"), F.size(F.array_distinct("c")).cast("long").alias("n_different"), F.array_join(F.transform("c", lambda x: F.concat_ws(".", x["app"], x["api"])), ",").alias("calls"))


_ROW = f"""{_VALUES}, {_BLOCKS},
n AS (SELECT *, lead(said) OVER (PARTITION BY task_id ORDER BY turn_no) AS next_said FROM b),
per AS (SELECT task_id, count(*) AS n_turns, sum(list_sum([length(x) FOR x IN blocks])) AS code_chars, count(*) FILTER (WHERE len(blocks) > 1) AS many, count(*) FILTER (WHERE failed) AS errors,
  count(*) FILTER (WHERE failed AND regexp_matches(next_said, '{tr.CAPITULATION.replace(chr(39), chr(39) * 2)}')) AS gave FROM n GROUP BY task_id),
docs AS (SELECT task_id, count(*) FILTER (WHERE app = 'api_docs' AND api = 'show_api_doc') AS docs, count(*) FILTER (WHERE app = 'api_docs' AND api = 'show_api_descriptions') AS descriptions FROM c GROUP BY task_id),
k AS (SELECT *, min(pos) FILTER (WHERE kind = 'description') OVER (PARTITION BY task_id, app) AS by_app, min(pos) FILTER (WHERE kind = 'doc') OVER (PARTITION BY task_id, app, api) AS by_api FROM e),
known AS (SELECT task_id, count(*) AS n_calls, count(*) FILTER (WHERE coalesce(by_app < pos, false) OR coalesce(by_api < pos, false)) AS n_known FROM k WHERE kind = 'call' GROUP BY task_id),
ep AS (SELECT DISTINCT task_id, turn_no, failed, app, api FROM e WHERE kind = 'call'),
g AS (SELECT *, max(turn_no) FILTER (WHERE NOT failed) OVER (PARTITION BY task_id, app, api) AS good FROM ep),
rec AS (SELECT task_id, count(*) AS n_failed, count(*) FILTER (WHERE good > turn_no) AS n_recovered FROM g WHERE failed GROUP BY task_id),
w AS (SELECT v.*, coalesce(n_turns, num_interactions, 0) AS nt, coalesce(code_chars, 0) AS cc, coalesce(many, 0) AS many, coalesce(errors, 0) AS errors, coalesce(gave, 0) AS gave, coalesce(docs, 0) AS docs, coalesce(descriptions, 0) AS descriptions,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_known, 0) AS n_known, coalesce(n_failed, 0) AS n_failed, coalesce(n_recovered, 0) AS n_recovered
  FROM v LEFT JOIN per USING (task_id) LEFT JOIN docs USING (task_id) LEFT JOIN known USING (task_id) LEFT JOIN rec USING (task_id)),
row_ AS (SELECT experiment, sum(pass_rate) / count(*) AS average_partial_pass_rate, CAST(sum(n_execution_failed) AS BIGINT) AS execution_failed_count, CAST(sum(invalid_api_hits) AS BIGINT) AS invalid_api_hits, count(*) AS num_rollouts_analyzed,
  sum(nt) / count(*) AS num_turns_avg, sum(cc) / count(*) AS code_chars_per_rollout, coalesce(sum(many) / nullif(sum(nt), 0), 0) AS multiple_code_cells_per_turn, coalesce(sum(errors) / nullif(sum(nt), 0), 0) AS execution_errors_per_turn,
  sum(docs) / count(*) AS api_doc_calls_per_rollout, sum(descriptions) / count(*) AS api_description_calls_per_rollout, (sum(docs) + sum(descriptions)) / count(*) AS api_doc_or_description_calls_per_rollout,
  coalesce(sum(n_known) / nullif(sum(n_calls), 0), 0) AS doc_before_api_call_rate, sum(assumption_words) / count(*) AS assumption_words_per_rollout, sum(assumption_words_extended) / count(*) AS assumption_words_extended_per_rollout,
  sum(dummy_words) / count(*) AS dummy_words_per_rollout, sum(dummy_words_extended) / count(*) AS dummy_words_extended_per_rollout, coalesce((sum(n_failed) - sum(n_recovered)) / nullif(sum(n_failed), 0), 0) AS failed_api_call_give_up_rate,
  CAST(sum(n_failed) AS BIGINT) AS failed_api_calls, CAST(sum(n_recovered) AS BIGINT) AS recovered_api_calls, CAST(sum(gave) AS BIGINT) AS capitulation_after_error_count FROM w GROUP BY experiment)"""
_RATES = ["average_partial_pass_rate", "num_turns_avg", "code_chars_per_rollout", "multiple_code_cells_per_turn", "execution_errors_per_turn", "api_doc_calls_per_rollout", "api_description_calls_per_rollout",
          "api_doc_or_description_calls_per_rollout", "doc_before_api_call_rate", "assumption_words_per_rollout", "assumption_words_extended_per_rollout", "dummy_words_per_rollout", "dummy_words_extended_per_rollout", "failed_api_call_give_up_rate"]
_METRICS = ["TGC", "SGC", "TGC_1", "TGC_2", "TGC_3", "SGC_1", "SGC_2", "SGC_3"]
_PATHS = {"eval_result_path": "results/", "eval_log_path": "logs/eval.log", "behavior_summary_path": "behaviour.json"}


@query(_ROW + f""" SELECT experiment AS experiment_name, experiment AS checkpoint_name, CAST(regexp_extract(experiment, '([0-9]+)', 1) AS INTEGER) AS checkpoint_iteration, {', '.join(f'CAST({0.5 + k / 8} AS DOUBLE) AS "{m}"' if m != 'SGC_3' else 'CAST(NULL AS DOUBLE) AS "SGC_3"' for k, m in enumerate(_METRICS))},
{', '.join(f"'{v}' AS {k}" for k, v in _PATHS.items())}, * EXCLUDE (experiment) REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in _RATES)}) FROM row_""")
def behaviour_row(spark, sf_dir):
    lines = spark.createDataFrame([(0, "TGC: 0.1 SGC: 0.2"), (1, "2024-01-01 model dev run " + " ".join(f"{m}: {0.5 + k / 8}" for k, m in enumerate(_METRICS[:-1]))), (2, "  ")], "n int, value string")
    official = files.read_result_line(lines, _METRICS, "n")
    row = bh.checkpoint_row(bh.behaviour(episodes(spark, sf_dir)), official, F.col("experiment"), _PATHS)
    return row.withColumnRenamed("experiment", "experiment_name").withColumns({c: rounded(c)[0] for c in _RATES})


@query(f"""WITH {EPISODES_SQL}, a AS (SELECT task_id, CAST(n AS INTEGER) AS score FROM v_episodes WHERE n % 2 = 0), b AS (SELECT task_id, CAST(-n AS INTEGER) AS score FROM v_episodes WHERE n % 3 = 0)
SELECT task_id, coalesce(a.score, b.score) AS score FROM v_episodes LEFT JOIN a USING (task_id) LEFT JOIN b USING (task_id)""")
def first_result(spark, sf_dir):
    tasks = episodes(spark, sf_dir).select("task_id")
    n = (F.col("task_id").cast("long") / 8).cast("int")
    return bh.first_result(tasks, [tasks.filter(n % 2 == 0).withColumn("score", n), tasks.filter(n % 3 == 0).withColumn("score", -n)])


_WIDE = "SELECT {}, round(avg(CAST(success AS DOUBLE)), 6) AS s, round(avg(ret), 6) AS r, count(*) AS n FROM v_rollouts GROUP BY ALL"


@query(f"""WITH {ROLLOUTS_SQL}, d AS ({_WIDE.format('CAST(difficulty AS VARCHAR) AS g')}), e AS ({_WIDE.format('dataset_name AS g')})
SELECT 'source_success_rate__' || g AS name, s AS value FROM e UNION ALL SELECT 'source_avg_return__' || g, r FROM e UNION ALL SELECT 'success_rate__' || g, s FROM d
UNION ALL SELECT 'success_rate__avg_over_dfcty', round(avg(x), 6) FROM (SELECT avg(CAST(success AS DOUBLE)) AS x FROM v_rollouts GROUP BY difficulty) UNION ALL SELECT 'n_rollouts__' || g, CAST(n AS DOUBLE) FROM d UNION ALL SELECT 'n_rollouts__total', CAST(count(*) AS DOUBLE) FROM v_rollouts""")
def named_metrics(spark, sf_dir):
    return metrics.named(rollouts(spark, sf_dir), "dataset_name", "difficulty").select("name", *rounded("value"))


@query(f"""WITH {ROLLOUTS_SQL} SELECT {', '.join(f"round(avg(CAST(success AS DOUBLE)) FILTER (WHERE difficulty = {d}), 6) AS success_rate__{d}" for d in (1, 2, 3))}, count(*) AS n_rollouts__total FROM v_rollouts""")
def wide_metrics(spark, sf_dir):
    found = metrics.wide(metrics.named(rollouts(spark, sf_dir), "dataset_name", "difficulty"), ["success_rate__1", "success_rate__2", "success_rate__3", "n_rollouts__total"])
    return found.select(*rounded("success_rate__1", "success_rate__2", "success_rate__3"), F.col("n_rollouts__total").cast("long").alias("n_rollouts__total"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x = ' || doc_id || chr(10) || 'y' || chr(10) || 'z' WHEN doc_id % 3 = 1 THEN '' ELSE 'open ' || doc_id END AS code FROM documents""")
def block_text(spark, sf_dir):
    body = F.col("doc_id").cast("string")
    kinds = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a ```python\n x = "), body, F.lit(" ``` b ```py\ny\n``` c ```python\nz"))).when(F.col("doc_id") % 3 == 1, "no ```PYTHON code``` here").otherwise(F.concat(F.lit("see ```py  open "), body))
    return table(spark, sf_dir, "documents").select("doc_id", tr.code_text(kinds).alias("code"))
