"""All queries of the library outside the corpus subpackage, with SQL for the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars, tokenizers
from tallyloom.operators import advantages as adv
from tallyloom.operators import checkpoints as cp
from tallyloom.operators import metrics, sampling, tokens, transcripts, windows
from tallyloom.plans.base import QUERIES, SQL, query, rounded
from tallyloom.sources import files
from tallyloom.sources.tables import CHECKPOINTS_SQL, ROLLOUTS_SQL, TOKENS_SQL, checkpoints, rollouts, table
from tallyloom.sources.tables import tokens as token_table
from tallyloom.storage import scratch
from tallyloom.streaming import batches

FLAGSHIP = "advantage_loo"
#: The vocabulary file of the queries that count tokens: the setting TALLYLOOM_TOKENIZER, or that of the tests' machine.
TOKENIZER = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_r = rounded


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).filter(~F.col("cancelled"))


_R = f"WITH {ROLLOUTS_SQL} "
_LIVE = f"WITH {ROLLOUTS_SQL}, live AS (SELECT * FROM v_rollouts WHERE NOT cancelled) "
_G = f"""WITH {ROLLOUTS_SQL}, g AS (SELECT *, count(*) OVER w AS n, sum(ret) OVER w AS s, stddev_pop(ret) OVER w AS d
  FROM v_rollouts WHERE NOT cancelled WINDOW w AS (PARTITION BY task)), a AS (SELECT *, ret - (s - ret) / (n - 1) AS advantage FROM g WHERE n >= 2) """


# --- advantages ---------------------------------------------------------------------------------


@query(_G + "SELECT task, rollout, n, round((s - ret) / (n - 1), 6) + 0.0::DOUBLE AS baseline, round(advantage, 6) + 0.0::DOUBLE AS advantage FROM a")
def advantage_loo(spark, sf_dir):
    return adv.advantages(_live(spark, sf_dir), ["task"]).select("task", "rollout", "n", *_r("baseline", "advantage"))


@query(_G + "SELECT task, rollout, round(s / n, 6) + 0.0::DOUBLE AS baseline, round(ret - s / n, 6) + 0.0::DOUBLE AS advantage FROM g WHERE n >= 2")
def advantage_lno(spark, sf_dir):
    return adv.advantages(_live(spark, sf_dir), ["task"], baseline="leave_none_out").select("task", "rollout", *_r("baseline", "advantage"))


@query(_G + "SELECT task, rollout, round(round(advantage / greatest(d, 1e-7), 9), 5) + 0.0::DOUBLE AS advantage FROM a WHERE d > 1e-9")
def advantage_normalised(spark, sf_dir):
    spread = _live(spark, sf_dir).groupBy("task").agg(F.stddev_pop("ret").alias("d")).filter("d > 1e-9").select("task")
    return adv.advantages(_live(spark, sf_dir), ["task"], normalise=True).join(spread, "task", "left_semi").select("task", "rollout", (F.round(F.round("advantage", 9), 5) + 0.0).alias("advantage"))


_KEEP = "c AS (SELECT count(*) AS total, count(*) FILTER (WHERE round(abs(advantage), 9) >= 0.25) AS above FROM a), k AS (SELECT total, CAST(least(greatest(ceil(above / 8), 1), floor(total / 8)) * 8 AS BIGINT) AS keep FROM c)"
_TOP = _G.rstrip() + f", {_KEEP}, t AS (SELECT *, row_number() OVER (ORDER BY round(abs(advantage), 9) DESC, rollout) AS rn FROM a) "


@query(_TOP + "SELECT task, rollout, round(advantage, 6) + 0.0::DOUBLE AS advantage FROM t, k WHERE rn <= keep")
def advantage_topk(spark, sf_dir):
    found = adv.advantages(_live(spark, sf_dir), ["task"])
    return adv.top_advantages(found, "rollout", 0.25, 8).select("task", "rollout", *_r("advantage"))


@query(_TOP + "SELECT any_value(total) AS total, any_value(keep) AS keep, round(1 - any_value(keep) / any_value(total), 6) AS filtered, round(coalesce(max(round(abs(advantage), 9)) FILTER (WHERE rn > keep), 0), 6) AS empirical_threshold FROM t, k")
def advantage_filter_stats(spark, sf_dir):
    return adv.filter_stats(adv.advantages(_live(spark, sf_dir), ["task"]), "rollout", 0.25, 8).select("total", "keep", *_r("filtered", "empirical_threshold"))


@query(_R + "SELECT worker, count(*) AS n, min(rollout) AS first, max(rollout) AS last FROM (SELECT rollout, CAST(ntile(8) OVER (ORDER BY rollout) - 1 AS INTEGER) AS worker FROM v_rollouts) GROUP BY worker")
def balanced_split(spark, sf_dir):
    return adv.split_evenly(rollouts(spark, sf_dir).select("rollout"), ["rollout"], 8).groupBy("worker").agg(F.count("*").alias("n"), F.min("rollout").alias("first"), F.max("rollout").alias("last"))


@query(_R + "SELECT scenario, rollout, CAST((row_number() OVER (PARTITION BY scenario ORDER BY rollout) - 1) // 32 AS BIGINT) AS batch FROM v_rollouts")
def minibatches(spark, sf_dir):
    return adv.minibatches(rollouts(spark, sf_dir).select("scenario", "rollout"), "scenario", ["rollout"], 32)


# --- metrics ------------------------------------------------------------------------------------

_SUMMARY = "count(*) FILTER (WHERE success) AS n_successes, count(*) AS n_tasks, round(avg(CAST(success AS DOUBLE)), 6) AS tgc, round(avg(passes / num_tests), 6) AS avg_pass_rate FROM v_rollouts"


@query(_R + "SELECT " + _SUMMARY)
def tgc_overall(spark, sf_dir):
    return metrics.summary(rollouts(spark, sf_dir)).select("n_successes", "n_tasks", *_r("tgc", "avg_pass_rate"))


@query(_R + f"SELECT difficulty, {_SUMMARY} GROUP BY difficulty")
def tgc_by_difficulty(spark, sf_dir):
    return metrics.summary(rollouts(spark, sf_dir), "difficulty").select("difficulty", "n_successes", "n_tasks", *_r("tgc", "avg_pass_rate"))


@query(_R + f"SELECT dataset_name, {_SUMMARY} GROUP BY dataset_name")
def source_metrics(spark, sf_dir):
    return metrics.summary(rollouts(spark, sf_dir), "dataset_name").select("dataset_name", "n_successes", "n_tasks", *_r("tgc", "avg_pass_rate"))


@query(_R + "SELECT difficulty, count(*) AS n, count(*) FILTER (WHERE success) AS n_successes FROM v_rollouts GROUP BY ROLLUP (difficulty)")
def difficulty_counts(spark, sf_dir):
    return metrics.with_total(rollouts(spark, sf_dir), "difficulty")


@query(_R + "SELECT count(*) AS n_groups, round(avg(rate), 6) AS macro_success FROM (SELECT difficulty, avg(CAST(success AS DOUBLE)) AS rate FROM v_rollouts GROUP BY difficulty)")
def macro_success(spark, sf_dir):
    return metrics.macro_success(rollouts(spark, sf_dir), "difficulty").select("n_groups", *_r("macro_success"))


@query(_R + "SELECT difficulty, CAST(least(floor(ret * 10), 9) + 1 AS INTEGER) AS bin, count(*) AS n FROM v_rollouts GROUP BY ALL")
def return_histogram(spark, sf_dir):
    return metrics.histogram(rollouts(spark, sf_dir), "difficulty")


@query(_R + "SELECT task, difficulty, round(greatest(max(ret), 0), 6) AS best FROM v_rollouts GROUP BY ALL")
def best_return_per_task(spark, sf_dir):
    return metrics.best_return(rollouts(spark, sf_dir), "task", "difficulty").select("task", "difficulty", *_r("best"))


@query(_R + "SELECT count(*) AS n_tasks, round(avg(CAST(best = 1 AS DOUBLE)), 6) AS attained_full FROM (SELECT task, max(ret) AS best FROM v_rollouts GROUP BY task)")
def attained_full_return(spark, sf_dir):
    return metrics.attained_full(rollouts(spark, sf_dir), "task").select("n_tasks", *_r("attained_full"))


@query(_R + "SELECT count(*) AS n_scenarios, round(avg(CAST(ok AS DOUBLE)), 6) AS sgc FROM (SELECT scenario, bool_and(ok) AS ok FROM (SELECT scenario, task, bool_or(success) AS ok FROM v_rollouts GROUP BY ALL) GROUP BY scenario)")
def scenario_completion(spark, sf_dir):
    return metrics.scenario_completion(rollouts(spark, sf_dir), "scenario", "task").select("n_scenarios", *_r("sgc"))


@query(_R + "SELECT rollout, CAST(success AS DOUBLE) AS sparse, round(greatest(0, passes / num_tests - 0.1 * n_exec_failed), 6) AS dense FROM v_rollouts")
def rewards(spark, sf_dir):
    return rollouts(spark, sf_dir).select("rollout", metrics.reward(True).alias("sparse"), F.round(metrics.reward(False, 0.1), 6).alias("dense"))


# --- tokens -------------------------------------------------------------------------------------

_T = f"WITH {TOKENS_SQL}, d AS (SELECT *, new_lp - old_lp AS d FROM v_tokens WHERE is_output) "


@query(_T + "SELECT rollout, round(-avg(d), 6) AS kl_k1, round(avg(exp(d) - 1 - d), 6) AS kl_k3 FROM d GROUP BY rollout")
def kl_divergence(spark, sf_dir):
    return tokens.divergences(tokens.log_ratios(token_table(spark, sf_dir))).select("rollout", *_r("kl_k1", "kl_k3"))


@query(_T + "SELECT rollout, round(exp(sum(d)), 6) AS weight, round(min(d), 6) AS d_min, round(max(d), 6) + 0.0::DOUBLE AS d_max, CAST(arg_min(i, (d, i)) - 17 AS BIGINT) AS argmin, CAST(arg_max(i, (d, -i)) - 17 AS BIGINT) AS argmax FROM d GROUP BY rollout")
def importance_weights(spark, sf_dir):
    return tokens.importance(tokens.log_ratios(token_table(spark, sf_dir))).select("rollout", *_r("weight", "d_min", "d_max"), "argmin", "argmax")


def _surrogate(per_token: bool, clip: bool):
    def run(spark, sf_dir):
        advantage = F.col("rollout") % 5 - 2.0
        return tokens.surrogate(tokens.log_ratios(token_table(spark, sf_dir)), advantage, per_token, clip).select("rollout", *_r("objective", "clipped_fraction"))

    kind = f"surrogate_{'token' if per_token else 'trajectory'}_{'clip' if clip else 'plain'}"
    bounded = "least(a * w, a * greatest(least(w, 1.1), 1 / 1.1::DOUBLE))" if clip else "a * w"
    rows = "SELECT rollout, rollout % 5 - 2.0::DOUBLE AS a, exp(d) AS w FROM d" if per_token else "SELECT rollout, rollout % 5 - 2.0::DOUBLE AS a, exp(sum(d)) AS w FROM d GROUP BY rollout"
    run.__name__ = kind
    query(_T + f"SELECT rollout, round(avg({bounded}), 6) AS objective, round(avg(CAST({bounded} <> a * w AS DOUBLE)), 6) AS clipped_fraction FROM ({rows}) GROUP BY rollout")(run)


for _per_token in (True, False):
    for _clip in (True, False):
        _surrogate(_per_token, _clip)


@query(_T + "SELECT scenario, round(avg(m), 6) AS mean_diff, round(max(hi), 6) AS max_diff, round(max(p95), 6) AS p95, round(min(p99), 6) AS p99 FROM (SELECT scenario, rollout, avg(abs(d)) AS m, max(abs(d)) AS hi, quantile_cont(abs(d), 0.95) AS p95, quantile_cont(abs(d), 0.99) AS p99 FROM d GROUP BY ALL) GROUP BY scenario")
def prob_diff_stats(spark, sf_dir):
    d = tokens.log_ratios(token_table(spark, sf_dir)).select("scenario", "rollout", F.explode("d").alias("d")).withColumn("d", F.abs("d"))
    each = d.groupBy("scenario", "rollout").agg(F.avg("d").alias("m"), F.max("d").alias("hi"), F.percentile("d", 0.95).alias("p95"), F.percentile("d", 0.99).alias("p99"))
    return each.groupBy("scenario").agg(F.avg("m").alias("mean_diff"), F.max("hi").alias("max_diff"), F.max("p95").alias("p95"), F.min("p99").alias("p99")).select("scenario", *_r("mean_diff", "max_diff", "p95", "p99"))


@query(f"WITH {TOKENS_SQL} SELECT rollout, count(*) AS n_tokens, count(*) FILTER (WHERE is_output) AS n_output, round(sum(old_lp), 5) AS sum_lp, true AS was_truncated FROM v_tokens WHERE i <= 40 GROUP BY rollout")
def sequence_truncation(spark, sf_dir):
    cut = tokens.truncated(token_table(spark, sf_dir), ["old_lp", "new_lp", "is_output"], 40)
    return cut.select("rollout", F.size("old_lp").cast("long").alias("n_tokens"), F.size(F.filter("is_output", lambda x: x)).cast("long").alias("n_output"), F.round(tokens.total(F.col("old_lp")), 5).alias("sum_lp"), "was_truncated")


# --- transcripts --------------------------------------------------------------------------------


@query("""WITH t AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations)
SELECT conv_id, turn_no, max(text) FILTER (WHERE role = 'assistant') AS said, coalesce(arg_min(text, turn) FILTER (WHERE role IN ('user', 'ipython')), '') AS observation FROM t WHERE turn_no > 0 GROUP BY ALL""")
def turn_pairs(spark, sf_dir):
    return transcripts.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations")
def next_message(spark, sf_dir):
    return transcripts.next_text(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "next_text")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)\b(?:the|and|der|que)\b')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(t, '(?i)token .* [a-z]+')) + len(regexp_extract_all(t, '(?i)licensed under')) AS BIGINT) AS n_patterns
FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS t FROM documents)""")
def word_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("t"))
    return docs.select("doc_id", transcripts.count_pattern(F.col("t"), r"(?i)\b(?:the|and|der|que)\b").alias("n_words"), transcripts.invalid_api_hits(F.col("t"), ["token .* [a-z]+", "licensed under"]).alias("n_patterns"))


_E = "SELECT user_id AS episode, event_id AS turn, event_type AS endpoint, value > 50 AS failed FROM events"


@query(f"""WITH e AS ({_E}), g AS (SELECT *, max(turn) FILTER (WHERE NOT failed) OVER (PARTITION BY episode, endpoint) AS good FROM e)
SELECT episode, count(*) AS n_failed, count(*) FILTER (WHERE good > turn) AS n_recovered, round((count(*) - count(*) FILTER (WHERE good > turn)) / count(*), 6) AS give_up_rate FROM g WHERE failed GROUP BY episode""")
def error_recovery(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("turn"), F.col("event_type").alias("endpoint"), (F.col("value") > 50).alias("failed"))
    return transcripts.recovery(calls).select("episode", "n_failed", "n_recovered", *_r("give_up_rate"))


_D = "SELECT user_id AS episode, event_id AS pos, event_type AS app, event_id % 3 AS api, CASE event_id % 7 WHEN 0 THEN 'description' WHEN 1 THEN 'doc' ELSE 'call' END AS kind FROM events"


@query(f"""WITH e AS ({_D}), g AS (SELECT *, min(pos) FILTER (WHERE kind = 'description') OVER (PARTITION BY episode, app) AS a, min(pos) FILTER (WHERE kind = 'doc') OVER (PARTITION BY episode, app, api) AS b FROM e)
SELECT episode, count(*) AS n_calls, count(*) FILTER (WHERE coalesce(a < pos, false) OR coalesce(b < pos, false)) AS n_documented FROM g WHERE kind = 'call' GROUP BY episode""")
def doc_before_call(spark, sf_dir):
    kind = F.when(F.col("event_id") % 7 == 0, "description").when(F.col("event_id") % 7 == 1, "doc").otherwise("call")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("pos"), F.col("event_type").alias("app"), (F.col("event_id") % 3).alias("api"), kind.alias("kind"))
    return transcripts.documented_before(events)


@query("""SELECT count(DISTINCT conv_id) AS n_episodes, count(*) FILTER (WHERE role = 'assistant') AS n_turns, round(count(*) FILTER (WHERE role = 'assistant') / count(DISTINCT conv_id), 6) AS turns_per_episode,
round(avg(length(text)), 6) AS mean_length, count(*) FILTER (WHERE text = '') AS n_empty FROM conversations""")
def episode_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg(
        F.countDistinct("conv_id").alias("n_episodes"), F.count_if(F.col("role") == "assistant").alias("n_turns"),
        F.round(F.count_if(F.col("role") == "assistant") / F.countDistinct("conv_id"), 6).alias("turns_per_episode"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.count_if(F.col("text") == "").alias("n_empty"),
    )


# --- checkpoints --------------------------------------------------------------------------------

_C = f"WITH {CHECKPOINTS_SQL} "
_BASE = "1-URGENT"


@query(_C + f"""SELECT c.*, round(c."TGC" / nullif(b."TGC", 0), 6) AS "ratio_TGC", round(c.invalid_api_hits / nullif(b.invalid_api_hits, 0), 6) AS ratio_invalid_api_hits, round(b.invalid_api_hits / nullif(c.invalid_api_hits, 0), 6) AS reduction_invalid_api_hits
FROM v_checkpoints c LEFT JOIN (SELECT * FROM v_checkpoints WHERE experiment = '{_BASE}') b USING (split)""")
def base_comparison(spark, sf_dir):
    found = cp.compare(checkpoints(spark, sf_dir), _BASE, ["TGC"], ["invalid_api_hits"])
    return found.select("split", "experiment", "TGC", "SGC", "execution_failed_count", "invalid_api_hits", *_r("ratio_TGC", "ratio_invalid_api_hits", "reduction_invalid_api_hits"))


@query(_C + """SELECT split, experiment, "TGC", "SGC", execution_failed_count, invalid_api_hits FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY "TGC" DESC NULLS LAST, "SGC" DESC NULLS LAST, -invalid_api_hits DESC NULLS LAST) AS r FROM v_checkpoints) WHERE r = 1""")
def best_checkpoint(spark, sf_dir):
    return cp.best(checkpoints(spark, sf_dir), "split", [F.col("TGC"), F.col("SGC"), -F.col("invalid_api_hits")])


@query(_C + f"""SELECT split, experiment, CASE WHEN experiment = '{_BASE}' THEN 0 ELSE execution_failed_count END AS execution_failed_count FROM v_checkpoints""")
def upsert_rows(spark, sf_dir):
    old = checkpoints(spark, sf_dir).select("split", "experiment", "execution_failed_count")
    new = old.filter(F.col("experiment") == _BASE).withColumn("execution_failed_count", F.lit(0).cast("long"))
    return cp.upsert(old, new, ["split", "experiment"])


@query(_C + f"SELECT split, experiment FROM v_checkpoints WHERE experiment <> '{_BASE}'")
def pending_checkpoints(spark, sf_dir):
    rows = checkpoints(spark, sf_dir).select("split", "experiment")
    return cp.pending(rows, rows.filter(F.col("experiment") == _BASE), ["split", "experiment"])


_NAMES = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'checkpoint-' || doc_id WHEN 1 THEN 'ckpt' || doc_id ELSE source END AS name FROM documents"


@query(f"SELECT doc_id, try_cast(nullif(regexp_extract(name, '(?:checkpoint-|ckpt)([0-9]+)', 1), '') AS INTEGER) AS iteration, doc_id % 3 < 2 AND doc_id % 20 = 0 AS due FROM ({_NAMES})")
def cadence(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("checkpoint-"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ckpt"), "doc_id")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", cp.iteration(name).alias("iteration"), cp.due(name, 20).alias("due"))


_LADDER = "CASE WHEN user_id % 100 >= 85 THEN 'hard_dead' WHEN value >= 65 THEN 'hard_dead' WHEN value >= 45 THEN 'soft_dead' WHEN value >= 35 THEN 'draining' WHEN value >= 25 THEN 'recycle_after_task' ELSE 'healthy' END"


@query(f"SELECT {_LADDER} AS state, count(*) AS n FROM events GROUP BY ALL")
def health_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(cp.health(F.col("value"), F.col("user_id") % 100).alias("state")).agg(F.count("*").alias("n"))


# --- windows ------------------------------------------------------------------------------------

_RUN = "SELECT event_id, event_type, ts, event_id * 1.0::DOUBLE AS v, epoch_us(ts) / 1e6 AS t FROM events"


@query(f"""WITH e AS (SELECT event_type, t, max(v) AS v FROM ({_RUN}) GROUP BY ALL), f AS (SELECT *, min((t, v)) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS a, lag((t, v)) OVER (PARTITION BY event_type ORDER BY t) AS b FROM e),
s AS (SELECT *, CASE WHEN a[1] < t THEN a ELSE b END AS s FROM f) SELECT event_type, round(t, 3) AS t, round((v - s[2]) / greatest(t - s[1], 1e-8), 6) AS per_second FROM s""")
def throughput_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("double").alias("v"))
    e = e.groupBy("event_type", (F.unix_micros("ts") / 1e6).alias("t")).agg(F.min("ts").alias("ts"), F.max("v").alias("v"))
    out = windows.throughput(e, "event_type", "ts", "v", 3600)
    # as SQL rounds: halves of the product, not of the shortest decimals
    return out.select("event_type", F.round("t", 3).alias("t"), (F.round(F.col("per_second") * 1e6) / 1e6 + 0.0).alias("per_second"))


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n >= 3")
def rolling_mean_burn(spark, sf_dir):
    return windows.rolling_mean(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 10, 3).select("event_type", "event_id", *_r("rolling_mean"))


@query("WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS span, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber // 2 END AS parent, l_quantity AS seconds FROM lineitem) SELECT s.span, round(s.seconds - coalesce(c.inner_s, 0), 6) AS exclusive FROM s LEFT JOIN (SELECT parent, sum(seconds) AS inner_s FROM s GROUP BY parent) c ON s.span = c.parent")
def exclusive_time(spark, sf_dir):
    n, key = F.col("l_linenumber"), F.col("l_orderkey") * 10
    spans = table(spark, sf_dir, "lineitem").select((key + n).alias("span"), F.when(n > 1, key + F.floor(n / 2)).alias("parent"), F.col("l_quantity").alias("seconds"))
    return windows.exclusive_time(spans).select("span", *_r("exclusive"))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM conversations")
def running_tokens(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return windows.running_total(m, "conv_id", "turn", "n").select("conv_id", "turn", "running_total")


@query("WITH e AS (SELECT DISTINCT o_custkey AS k, o_orderkey // 50 AS x FROM orders), i AS (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM e) SELECT k, min(x) AS first, max(x) AS last, count(*) AS n FROM i GROUP BY k, g")
def range_compact(spark, sf_dir):
    numbers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 50).alias("x")).distinct()
    return windows.ranges(numbers, "k", "x").select("k", "first", "last", "n")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 3")
def retention(spark, sf_dir):
    return windows.expired(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
g AS (SELECT event_type, event_id, value, k, value <= 60 AS accepted, CASE WHEN value <= 60 AND value > 0 THEN 1 ELSE 0 END AS n, CASE WHEN value <= 60 AND value > 0 THEN value ELSE 0.0::DOUBLE END AS mean, 0.0::DOUBLE AS square FROM o WHERE k = 1
  UNION ALL SELECT event_type, event_id, value, k, accepted, CASE WHEN accepted AND value > 0 THEN n + 1 ELSE n END, CASE WHEN accepted AND value > 0 THEN mean + (value - mean) / (n + 1) ELSE mean END,
    CASE WHEN accepted AND value > 0 THEN square + (value - mean) * (value - (mean + (value - mean) / (n + 1))) ELSE square END
  FROM (SELECT o.event_type, o.event_id, o.value, o.k, g.n, g.mean, g.square, o.value <= 60 AND (g.n < 3 OR o.value <= g.mean + 1.5 * sqrt(g.square / nullif(g.n, 0))) AS accepted FROM g JOIN o ON o.event_type = g.event_type AND o.k = g.k + 1))
SELECT event_type, event_id, value, accepted FROM g""")
def outlier_gate(spark, sf_dir):
    return windows.outlier_gate(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 60.0, 1.5)


# --- sets and sampling --------------------------------------------------------------------------

_U = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def dedupe_ordered(spark, sf_dir):
    return sampling.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def split_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.filter("lang = 'en'").union(docs.filter("lang = 'de'"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def denylist_anti(spark, sf_dir):
    return cp.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query(f"SELECT epoch, c_custkey, CAST(row_number() OVER (PARTITION BY epoch ORDER BY {_U.format("c_custkey || '|' || epoch || '|7'")}, c_custkey) AS INTEGER) AS place FROM customer, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS epoch)")
def epoch_sampler(spark, sf_dir):
    return sampling.epochs(spark, table(spark, sf_dir, "customer"), "c_custkey", 3, 7).select("epoch", "c_custkey", "place")


@query(f"SELECT c_custkey, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS sampler FROM (SELECT c_custkey, {_U.format("c_custkey || '|7'")} AS u FROM customer)")
def mixture_sampler(spark, sf_dir):
    return sampling.mixture(table(spark, sf_dir, "customer"), "c_custkey", {"a": 0.5, "b": 0.3, "c": 0.2}, 7).select("c_custkey", "sampler")


@query(_R + f"SELECT success, rollout FROM (SELECT success, rollout, row_number() OVER (PARTITION BY success ORDER BY {_U.format("rollout || '|7'")}, rollout) AS r FROM v_rollouts) WHERE r <= 2")
def success_failure_sample(spark, sf_dir):
    return sampling.per_group(rollouts(spark, sf_dir), "success", "rollout", 2, 7).select("success", "rollout")


@query(f"SELECT event_id FROM events WHERE {_U.format("event_id || '|7'")} < 0.05")
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(table(spark, sf_dir, "events"), "event_id", 0.05, 7).select("event_id")


# --- sources and sinks --------------------------------------------------------------------------


@query("SELECT DISTINCT source AS task_id FROM documents WHERE source NOT IN ('src1')")
def split_roundtrip(spark, sf_dir):
    folder, ids = scratch(spark, "splits"), table(spark, sf_dir, "documents").select(F.col("source").alias("task_id")).distinct()
    files.write_split(ids, f"{folder}/all.txt")
    return files.read_split(spark, folder, "all", spark.createDataFrame([("src1",)], "task_id string"))


@query("SELECT CAST(conv_id AS VARCHAR) AS task_id, CAST(turn AS INTEGER) AS msg_idx, role, text AS content, false AS cancelled FROM conversations")
def episode_json_roundtrip(spark, sf_dir):
    path = scratch(spark, "episodes")
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    episodes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(history.alias("chat_history"))
    files.write_episodes(episodes.select(F.struct(F.col("conv_id").cast("string").alias("task_id")).alias("task"), "chat_history", F.lit(-1).alias("n_execution_failed")), path)
    read = files.read_episodes(spark, path)
    return files.messages(read).join(read.select("task_id", "cancelled"), "task_id").select("task_id", "msg_idx", "role", "content", "cancelled")


@query("SELECT n_name AS name, n_regionkey AS number FROM nation")
def pipe_table(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("| "), "n_name", F.lit(" |  "), F.col("n_regionkey").cast("string"), F.lit(" |")).alias("value"))
    header = spark.createDataFrame([("| name | number |",), ("|------|-------|",)], "value string")
    return files.parse_pipe_table(header.union(lines), ["name", "number"]).withColumn("number", F.col("number").cast("int"))


@query(f"WITH {CHECKPOINTS_SQL} SELECT split, experiment, execution_failed_count AS n FROM v_checkpoints")
def history_json(spark, sf_dir):
    path, rows = scratch(spark, "history"), checkpoints(spark, sf_dir).select("split", "experiment", F.col("execution_failed_count").alias("n"))
    for part in ("experiment < '3'", "experiment >= '3'"):
        files.append_history(rows.filter(part), path)
    return spark.read.schema(rows.schema).json(path)


# --- batches and streams ------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_rates(spark, sf_dir):
    return batches.event_rates(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value > 10")
def stream_batches(spark, sf_dir):
    path, schema = scratch(spark, "stream"), table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")  # a pattern, as the table may be a file or a folder
    batches.commit_batches(stream.filter("value > 10").select("event_id", "user_id", "value"), path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""WITH r AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS scenario FROM events WHERE event_id % 10 <> 3), k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY event_id) AS k, row_number() OVER (ORDER BY event_id) AS n FROM r)
SELECT max(event_id) AS stop_at, CAST(18 AS INTEGER) AS needed, CAST(4 AS INTEGER) AS needed_each FROM k WHERE n = 18 OR k = 4""")
def early_stop_point(spark, sf_dir):
    results = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("scenario"), (F.col("event_id") % 10 == 3).alias("cancelled"))
    return batches.early_stop(results, 4, 6, "event_id", 0.75, 0.75)


@query("SELECT event_id, user_id FROM (SELECT event_id, event_id // 3 AS user_id, value > 8 AS failed, count(*) FILTER (WHERE value > 8) OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS f, count(*) FILTER (WHERE NOT value > 8) OVER (PARTITION BY event_id // 3) AS ok FROM events) WHERE failed AND f <= 2 AND ok = 0")
def retry_budget(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("user_id"), (F.col("value") > 8).alias("failed"))
    return batches.within_budget(attempts, "user_id", "event_id", 2).select("event_id", "user_id")


# --- scalar functions, ordinals and running statistics ------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
NOT regexp_matches(text, '[^\x00-\x7F]') AS is_ascii, 'iteration-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS key FROM documents""")
def names_and_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.slug(F.col("text")).alias("slug"), scalars.is_ascii(F.col("text")).alias("is_ascii"), scalars.padded_key("iteration", F.col("doc_id")).alias("key"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped, regexp_extract(url, '^([a-z]+):/', 1) AS scheme FROM pages""")
def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.html_escaped(F.col("html")).alias("escaped"), scalars.scheme(F.col("url")).alias("scheme"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def conversation_transcripts(spark, sf_dir):
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return grouped.select("conv_id", scalars.transcript(F.col("m")).alias("transcript"))


@query("SELECT o_custkey, o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS group_no, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no FROM orders")
def rollout_ordinals(spark, sf_dir):
    return windows.ordinals(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id, round(round(avg(v) OVER w, 9), 6) AS running_mean, round(round(stddev_pop(v) OVER w, 9), 5) AS running_std
FROM (SELECT user_id, event_id, CASE WHEN value > 20 THEN value - 20 END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 20).alias("v"))
    return windows.running_statistics(e, "user_id", "event_id", "v").select("user_id", "event_id", F.round(F.round("running_mean", 9), 6).alias("running_mean"), F.round(F.round("running_std", 9), 5).alias("running_std"))


@query(f"WITH {TOKENS_SQL} SELECT count(DISTINCT rollout) AS n_rollouts, count(*) AS n_tokens, count(*) FILTER (WHERE is_output) AS n_output, round(sum(old_lp) / count(DISTINCT rollout), 5) AS lp_per_rollout FROM v_tokens")
def rollout_statistics(spark, sf_dir):
    t = token_table(spark, sf_dir).select(F.size("old_lp").alias("n"), F.size(F.filter("is_output", lambda x: x)).alias("o"), tokens.total(F.col("old_lp")).alias("s"))
    return t.agg(F.count("*").alias("n_rollouts"), F.sum("n").alias("n_tokens"), F.sum("o").alias("n_output"), F.round(F.sum("s") / F.count("*"), 5).alias("lp_per_rollout"))


_CUT = len(transcripts.CUT)
_LEN = "CASE WHEN place >= 0 THEN coalesce(length({}), 0) ELSE 0 END"


@query(f"""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER w - 3 AS place, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w + 1 AS remain,
    CASE WHEN bool_or(role = 'ipython') OVER (PARTITION BY conv_id) THEN 'ipython' ELSE 'user' END AS kind FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  a AS (SELECT *, place >= 0 AND role = kind AND remain > 2 AS pick, {_LEN.format('text')} AS len FROM m),
  b AS (SELECT *, sum(len) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN pick THEN len - {len(transcripts.OMITTED)} ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
  c AS (SELECT *, CASE WHEN pick AND min(CASE WHEN place >= 0 THEN before END) OVER (PARTITION BY conv_id ORDER BY turn) > 150 THEN '{transcripts.OMITTED}' ELSE text END AS text2 FROM b),
  d AS (SELECT conv_id, turn, role, place, remain, text2, place >= 0 AND role = kind AND length(text2) > 60 AS pick, {_LEN.format('text2')} AS len FROM c),
  e AS (SELECT *, sum(len) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN pick THEN len - 60 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
  f AS (SELECT *, CASE WHEN pick AND min(CASE WHEN place >= 0 THEN before END) OVER (PARTITION BY conv_id ORDER BY turn) > 150 THEN left(text2, {60 - _CUT}) || '{transcripts.CUT}' ELSE text2 END AS text3 FROM e),
  g AS (SELECT *, sum({_LEN.format('text3')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f)
  SELECT conv_id, turn, role, text3 AS text FROM g WHERE place < 0 OR rest <= 150 OR remain <= 2""")
def truncated_history(spark, sf_dir):
    return transcripts.truncated_history(table(spark, sf_dir, "conversations"), "conv_id", "turn", n_prompt=2, most=150, most_message=60, recent=2).select("conv_id", "turn", "role", "text")


_ESC = "replace(replace(replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""WITH m AS (SELECT *, row_number() OVER w - 1 AS no, coalesce(length(text), 0) AS size, sum(coalesce(length(text), 0)) OVER w AS run FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, string_agg('<section class="' || {_ESC.format('role')} || '"><h3>#' || no || ' size ' || size || ' sum ' || run || ' interaction ' || ((greatest(0, no) + 1) // 2) || '</h3><pre>' || {_ESC.format('text')} || '</pre></section>', chr(10) ORDER BY no) AS html FROM m GROUP BY conv_id""")
def conversation_report(spark, sf_dir):
    return transcripts.report(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"))


@query(None)
def message_tokens(spark, sf_dir):
    size = tokenizers.message_size(spark, TOKENIZER, F.col("role"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("n_tokens"))


@query(None)
def output_cut_to_tokens(spark, sf_dir):
    cut = tokenizers.cut_to_tokens(spark, TOKENIZER, F.col("text"), 50)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("text"))


# the other modules add their queries when they are imported
from tallyloom.plans import episodes, runs, values  # noqa: E402, F401
