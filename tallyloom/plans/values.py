"""Queries over token arrays, gates of a training step, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars
from tallyloom.operators import checkpoints as cp
from tallyloom.operators import tokens, transcripts
from tallyloom.plans.base import query, rounded
from tallyloom.sources.tables import TOKENS_SQL, table
from tallyloom.sources.tables import tokens as token_table

_STOPS, _END, _NEWLINE = [151645, 151643], 151645, [198]
_MADE = "[CAST(conv_id * 10 + x AS INTEGER) FOR x IN range(length(text) % 6)] || CASE WHEN conv_id % 3 <> 0 AND length(text) % 6 > 0 THEN [151645] ELSE CAST([] AS INTEGER[]) END"


def _messages(spark, sf_dir):
    """Conversations as messages with tokens: those of an assistant are a policy's."""
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    n = F.length("text") % 6
    made = F.concat(F.transform(upto(n), lambda x: (F.col("conv_id") * 10 + x).cast("int")), F.when((F.col("conv_id") % 3 != 0) & (n > 0), F.array(F.lit(151645))).otherwise(F.array().cast("array<int>")))
    m = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("role") == "assistant").alias("policy"), upto(F.length("text") % 4).alias("message_tokens"), F.array(*map(F.lit, (151644, 77091, 198))).alias("prompt_tokens"),
        made.alias("generated_tokens"), (F.col("conv_id") % 3 == 0).alias("stopped"),
    )
    return m.withColumn("generated_logprobs", F.transform("generated_tokens", lambda _, i: -(i + 1) / F.lit(8.0)))


@query(f"""WITH m AS (SELECT conv_id, turn, role = 'assistant' AS policy, {_MADE} AS made, [CAST(x AS INTEGER) FOR x IN range(length(text) % 4)] AS own FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN policy THEN [151644, 77091, 198] || made || CASE WHEN len(made) = 0 OR conv_id % 3 = 0 THEN [151645] ELSE CAST([] AS INTEGER[]) END || [198] ELSE own END AS tokens, CASE WHEN policy THEN len(made) ELSE 0 END AS n, CASE WHEN policy THEN len(made) * (len(made) + 1) / 2 / -8 ELSE 0 END AS lp FROM m)
SELECT conv_id, array_to_string(flatten(list(tokens ORDER BY turn)), ',') AS tokens, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, CAST(sum(n) AS BIGINT) AS n_output, round(sum(lp), 6) + 0.0::DOUBLE AS log_prob FROM t GROUP BY conv_id""")
def policy_tokens(spark, sf_dir):
    each = tokens.aligned(_messages(spark, sf_dir), _STOPS, _END, _NEWLINE)
    whole = tokens.joined_in_order(each, "conv_id", "turn", ["tokens", "is_output", "log_probs"])
    same = (F.size("tokens") == F.size("is_output")) & (F.size("tokens") == F.size("log_probs"))
    known = F.filter("log_probs", lambda x: ~F.isnan(x))
    return whole.filter(same).select("conv_id", F.array_join("tokens", ",").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("is_output", lambda x: x)).cast("long").alias("n_output"), (F.round(tokens.total(known), 6) + 0.0).alias("log_prob"))


@query(f"""WITH {TOKENS_SQL}, d AS (SELECT scenario, rollout, abs(new_lp - old_lp) AS lp, abs(exp(new_lp) - exp(old_lp)) AS p, exp(new_lp) / greatest(exp(old_lp), 1e-12) AS w FROM v_tokens WHERE is_output),
e AS (SELECT scenario, rollout, avg(lp) AS alp, max(lp) AS mlp, avg(p) AS ap, max(p) AS mp, quantile_cont(p, 0.95) AS p95, quantile_cont(p, 0.99) AS p99, min(w) AS lw, max(w) AS hw FROM d GROUP BY ALL)
SELECT scenario, round(avg(alp), 6) AS avg_logprob_diff, round(max(mlp), 6) AS max_logprob_diff, round(avg(ap), 6) AS avg_prob_diff, round(max(mp), 6) AS max_prob_diff, round(max(p95), 6) AS max_p95_prob_diff, round(max(p99), 6) AS max_p99_prob_diff, round(min(lw), 6) AS min_imp_weight, round(max(hw), 6) AS max_imp_weight FROM e GROUP BY scenario""")
def recompute_stats(spark, sf_dir):
    found = tokens.recompute_stats(token_table(spark, sf_dir), ["scenario"])
    return found.select("scenario", *rounded(*found.columns[1:]))


@query(f"WITH {TOKENS_SQL} SELECT rollout, round(min(new_lp - old_lp), 6) AS d_min, round(max(new_lp - old_lp), 6) + 0.0::DOUBLE AS d_max FROM v_tokens WHERE is_output GROUP BY rollout HAVING greatest(max(new_lp - old_lp), -min(new_lp - old_lp)) > 0.2")
def drifted_rollouts(spark, sf_dir):
    return tokens.drifted(token_table(spark, sf_dir), 0.2).select("rollout", *rounded("d_min", "d_max"))


_STEP = "SELECT event_id // 20 AS step, CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS loss, CASE WHEN event_id // 20 % 5 = 0 THEN value ELSE -value / 10 END AS lw FROM events"


@query(f"""SELECT step, kl_estimate, CASE WHEN isnan(avg_loss) THEN NULL ELSE round(avg_loss, 6) END AS avg_loss, CASE WHEN isnan(avg_loss) THEN 'skip' WHEN abs(kl_estimate) > 20 THEN 'stop' ELSE 'step' END AS action
FROM (SELECT step, avg(loss) AS avg_loss, round(-avg(lw), 6) + 0.0::DOUBLE AS kl_estimate FROM ({_STEP}) GROUP BY step)""")
def loss_gate(spark, sf_dir):
    step = F.floor(F.col("event_id") / 20)
    e = table(spark, sf_dir, "events").select(
        step.alias("step"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"), F.when(step % 5 == 0, F.col("value")).otherwise(-F.col("value") / 10).alias("lw"))
    found = tokens.loss_gate(e, ["step"], "loss", "lw", 20.0)
    return found.select("step", *rounded("kl_estimate"), F.when(~F.isnan("avg_loss"), F.round("avg_loss", 6)).alias("avg_loss"), "action")


@query("WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), n AS (SELECT label, sqrt(sum(x * x)) AS two, max(abs(x)) AS most FROM x GROUP BY label) SELECT label, round(two, 6) AS norm, round(least(1, 3.5 / (two + 1e-6)), 6) AS coefficient, round(most, 6) AS norm_inf, round(least(1, 0.5 / (most + 1e-6)), 6) AS coefficient_inf FROM n")
def clip_coefficient(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    two = tokens.clip_coefficient(x, ["label"], "x", 3.5)
    most = tokens.clip_coefficient(x, ["label"], "x", 0.5, float("inf")).withColumnsRenamed({"norm": "norm_inf", "coefficient": "coefficient_inf"})
    return two.join(most, "label").select("label", *rounded("norm", "coefficient", "norm_inf", "coefficient_inf"))


@query(f"WITH {TOKENS_SQL}, d AS (SELECT rollout, new_lp - old_lp AS d FROM v_tokens WHERE is_output), w AS (SELECT rollout, sum(d) AS s FROM d GROUP BY rollout) SELECT rollout, round((any_value(rollout % 5) - 2.0::DOUBLE - 0.25 * any_value(s)) * avg(exp(d)), 6) + 0.0::DOUBLE AS objective FROM d JOIN w USING (rollout) GROUP BY rollout")
def surrogate_with_kl(spark, sf_dir):
    d = tokens.log_ratios(token_table(spark, sf_dir))
    return tokens.surrogate(d, F.col("rollout") % 5 - 2.0, True, False, kl_term=-0.25 * tokens.total(F.col("d"))).select("rollout", *rounded("objective"))


@query("SELECT rollout, CASE WHEN rollout % 2 = 0 THEN CAST(rollout AS DOUBLE) / 4 END AS advantage, rollout % 3 = 0 AS has_id FROM (SELECT vec_id AS rollout FROM embeddings)")
def matched_by_key(spark, sf_dir):
    r = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rollout"))
    advantage = r.filter("rollout % 2 = 0").withColumn("advantage", F.col("rollout") / 4.0)
    ids = r.filter("rollout % 3 = 0").withColumn("id", F.col("rollout"))
    return r.join(advantage, "rollout", "left").join(ids, "rollout", "left").select("rollout", "advantage", F.col("id").isNotNull().alias("has_id"))


# --- scalar functions ---------------------------------------------------------------------------


@query(r"""SELECT page_id, split_part(u, '://', 1) AS scheme, split_part(u, '://', 2) AS path FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'file://' || regexp_replace(url, '[:/]+', '.', 'g') ELSE regexp_replace(url, '^([a-z]+):/+([^/])', '\1://\2') END AS u FROM pages)""")
def uri_parts(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "[:/]+", ".")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "://", ":/")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.uri_parts(url).alias("u")).select("page_id", "u.*")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) WHEN event_id % 3 = 1 THEN value ELSE least(event_id, value) END AS least_known, round(CASE WHEN event_id % 4 > 0 AND event_id % 5 > 0 THEN value / (event_id % 4) END, 6) AS safe_div,
round_even(event_id / 8, 1) AS half_even, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, date_trunc('second', ts) AS parsed, CASE WHEN 4 + event_id % 20 + 10 >= 20 THEN CASE WHEN 20 - (4 + event_id % 20) - 1 > 1 THEN CAST(20 - (4 + event_id % 20) - 1 AS INTEGER) END ELSE 10 END AS new_tokens FROM events""")
def scalar_values(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.least_known(F.when(i % 3 != 1, i.cast("double")), F.when(i % 3 != 0, v)).alias("least_known"),
        F.round(scalars.safe_div(F.when(i % 5 > 0, v.cast("string")).otherwise("none"), (i % 4).cast("string")), 6).alias("safe_div"), scalars.half_even(i / 8, 1).alias("half_even"),
        scalars.stamp(F.col("ts")).alias("stamp"), scalars.parsed_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("parsed"), scalars.new_tokens((i % 20 + 4).cast("int"), 10, 20).alias("new_tokens"))


@query("""SELECT o_custkey, array_to_string([array_to_string(d[k * 3 + 1:k * 3 + 3], ',') FOR k IN range(CAST(ceil(len(d) / 3) AS BIGINT))], ';') AS groups, array_to_string([CAST(8000 + 2 * k AS VARCHAR) FOR k IN range(CAST(ceil(len(d) / 3) AS BIGINT))], ',') AS ports,
array_to_string(list_sort(list_intersect(d, [1, 2, 3, 4])), ',') AS shared, len(list_intersect(d, [1, 2, 3, 4])) > 0 AS overlap FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 16)) AS d FROM orders GROUP BY o_custkey)""")
def device_groups(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 16)).alias("d"))
    groups, some = scalars.chunks(F.col("d"), 3), F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 4)))
    return d.select("o_custkey", F.array_join(F.transform(groups, lambda g: F.array_join(g, ",")), ";").alias("groups"), F.array_join(scalars.ports(F.lit(8000), F.size(groups)), ",").alias("ports"),
                    F.array_join(F.sort_array(F.array_intersect("d", some)), ",").alias("shared"), F.arrays_overlap("d", some).alias("overlap"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a=2,b=' || doc_id || ',c=x' ELSE 'a=2,b=y,c=x' END AS merged, replace(lang || ' ' || source, ' ', '') AS compact,
CASE WHEN lang = 'en' THEN 1.0::DOUBLE WHEN lang = 'de' THEN 0.5 ELSE -1.0 END AS score, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid, CASE doc_id % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'assistant' ELSE 'user' END AS kind FROM documents""")
def maps_and_roles(spark, sf_dir):
    i = F.col("doc_id")
    first = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(i % 4 == 0, i.cast("string")).otherwise("z"))
    later = F.when(i % 4 == 0, F.create_map(F.lit("c"), F.lit("x"), F.lit("a"), F.lit("2"))).otherwise(F.create_map(F.lit("b"), F.lit("y"), F.lit("c"), F.lit("x"), F.lit("a"), F.lit("2")))
    scores = F.create_map(F.lit("en"), F.lit(1.0), F.lit("de"), F.lit(0.5))
    output = F.when(i % 5 == 0, "x\nExecution failed. y").otherwise("fine")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.transform(F.map_entries(scalars.overlaid(first, later)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"), scalars.compact(F.concat_ws(" ", "lang", "source")).alias("compact"),
        scalars.score(F.coalesce("lang", F.lit("")), scores).alias("score"), scalars.valid_candidate(output, i % 7 == 0).alias("valid"),
        scalars.message_kind(F.when(i % 3 == 2, "user").otherwise("assistant"), F.when(i % 3 == 0, F.array(i))).alias("kind"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'out of memory' WHEN 1 THEN 'no cuda' WHEN 2 THEN NULL ELSE 'connection refused' END AS reason, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS token_id,
CASE WHEN doc_id % 3 = 0 THEN 'Qwen-' || doc_id ELSE 'm' || doc_id END AS short, CAST(greatest(1, ceil((doc_id % 9) / 4)) * 3 AS BIGINT) AS runners, 'system be ' || doc_id || chr(10) || '|user  do USER: x' || chr(10) || '|assistant ' AS parts FROM documents""")
def names_and_failures(spark, sf_dir):
    i, t = F.col("doc_id"), F.col("doc_id").cast("string")
    log = F.concat(F.lit("connection refused\n# command_start a\nNo CUDA # command_start b\n"), F.when(i % 4 == 0, "CUDA Out Of Memory").when(i % 4 == 1, "error: No cuda").when(i % 4 == 2, "broken").otherwise("Connection Refused"))
    template = F.concat(F.lit("SYSTEM:\nbe "), t, F.lit("\nUSER:\n do USER: x\nASSISTANT:\n"))
    parts = F.transform(scalars.prompt_messages(template), lambda p: F.concat_ws(" ", p["role"], p["text"]))
    return table(spark, sf_dir, "documents").select(
        "doc_id", cp.failure_reason(log).alias("reason"), scalars.token_id(F.concat(F.lit("token_id:"), F.when(i % 2 == 0, t).otherwise("0"))).cast("long").alias("token_id"),
        scalars.short_model(F.when(i % 3 == 0, F.concat(F.lit("hub/Qwen-"), t, F.lit("-Instruct-x"))).otherwise(F.concat(F.lit("m"), t))).alias("short"),
        scalars.runners((i % 9).cast("int"), F.lit(4), F.lit(3)).cast("long").alias("runners"), F.array_join(parts, "|").alias("parts"))


@query("""SELECT user_id, CAST(coalesce(min(k) FILTER (WHERE ok AND v = most), 0) AS INTEGER) AS chosen FROM (SELECT *, max(v) FILTER (WHERE ok) OVER (PARTITION BY user_id) AS most FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id % 3 <> 0 AND value < 20 AS ok, floor(value) AS v FROM events)) GROUP BY user_id""")
def chosen_candidate(spark, sf_dir):
    c = F.array_sort(F.collect_list(F.struct("event_id", ((F.col("event_id") % 3 != 0) & (F.col("value") < 20)).alias("valid"), F.floor("value").alias("reward"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(c.alias("c")).select("user_id", scalars.best_candidate(F.col("c")).alias("chosen"))


@query(f"SELECT doc_id, {', '.join(f'''CAST(len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS {n}''' for n, p in (('assumption', transcripts.ASSUMPTION), ('assumption_extended', transcripts.ASSUMPTION_EXTENDED), ('dummy', transcripts.DUMMY), ('dummy_extended', transcripts.DUMMY_EXTENDED), ('capitulation', transcripts.CAPITULATION)))} FROM (SELECT doc_id, replace(replace(coalesce(text, ''), 'a', ' assume '), 'e', ' can''t fake ') AS t FROM documents)")
def wording(spark, sf_dir):
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("a"), F.lit(" assume ")), F.lit("e"), F.lit(" can't fake "))
    names = {"assumption": transcripts.ASSUMPTION, "assumption_extended": transcripts.ASSUMPTION_EXTENDED, "dummy": transcripts.DUMMY, "dummy_extended": transcripts.DUMMY_EXTENDED, "capitulation": transcripts.CAPITULATION}
    return table(spark, sf_dir, "documents").select("doc_id", *(transcripts.count_pattern(t, p).alias(n) for n, p in names.items()))
