"""Hand-checked rows, and the parts that SQL can't express."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars, tokenizers
from tallyloom.operators import advantages as adv
from tallyloom.operators import checkpoints as cp
from tallyloom.operators import metrics, tokens, transcripts, windows
from tallyloom.sources import files
from tallyloom.streaming import batches


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "baseline,normalise,want",
    [("leave_one_out", False, [0.75, -0.75, 0]), ("leave_none_out", False, [0.5, -0.5, 0]), ("leave_one_out", True, [1.837117, -1.837117, 0]), ("leave_none_out", True, [1.224745, -1.224745, 0])],
)
def test_advantages(spark, baseline, normalise, want):
    df = frame(spark, [(1, 0, 1.0), (1, 1, 0.0), (1, 2, 0.5), (2, 3, 1.0)], "g int, k int, ret double")
    got = adv.advantages(df, ["g"], baseline=baseline, normalise=normalise).orderBy("k").collect()
    assert [r.advantage for r in got] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("sizes,keep,filtered,threshold", [((0.75, 0.75, 0.5, 0, 0, 0), 4, 1 / 3, 0), ((0.75, 0.7, 0.6, 0.5, 0.4), 4, 0.2, 0.4), ((0, 0, 0, 0), 2, 0.5, 0)])
def test_keep_count(spark, sizes, keep, filtered, threshold):
    row = adv.filter_stats(frame(spark, [(k, float(v)) for k, v in enumerate(sizes)], "k int, advantage double"), "k", 0.01, 2).first()
    assert (row.keep, row.filtered, row.empirical_threshold) == (keep, pytest.approx(filtered), threshold)


def test_token_statistics(spark):
    clip = [tokens.clipped(F.lit(a), F.lit(w), 0.1) for a, w in ((1.0, 1.5), (1.0, 0.5), (-1.0, 1.5), (-1.0, 0.5))]
    assert list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(clip))).first()) == pytest.approx([1.1, 0.5, -1.5, -0.909091], abs=1e-6)
    d = frame(spark, [([0.1, -0.2, 0.3],)], "d array<double>")
    assert list(tokens.divergences(d).select("kl_k1", "kl_k3").first()) == pytest.approx([-0.066667, 0.024587], abs=1e-6)
    df = frame(spark, [([-1.0, -2.0, -0.5, -9.0], [-0.9, -2.2, -0.5, -1.0], [True, True, True, False])], "old_lp array<double>, new_lp array<double>, is_output array<boolean>")
    row = tokens.importance(tokens.log_ratios(df)).first()
    assert (round(row.weight, 6), row.argmax, row.argmin) == (0.904837, 0, 1)


def test_reward_and_parameters(spark):
    df = frame(spark, [(3, 4, 2, False), (0, 4, 1, False)], "passes int, num_tests int, n_exec_failed int, success boolean")
    assert [r[0] for r in df.select(metrics.reward(False, 0.1)).collect()] == pytest.approx([0.55, 0])
    for bad in (lambda: metrics.reward(False, -1), lambda: cp.health(F.col("a"), F.col("b"), (3, 2, 4, 5)), lambda: adv.advantages(df, ["passes"], baseline="none")):
        with pytest.raises(ValueError):
            bad()


def test_health_and_failures(spark):
    df = frame(spark, [(10.0, 90.0), (65.0, 10.0), (50.0, 60.0), (35.0, 10.0), (25.0, 10.0), (24.9, 10.0)], "r double, h double")
    assert [r[0] for r in df.select(cp.health(F.col("r"), F.col("h"))).collect()] == ["hard_dead", "hard_dead", "soft_dead", "draining", "recycle_after_task", "healthy"]
    logs = ["CUDA out of memory", "no cuda # command_start fine", None]
    assert [r[0] for r in frame(spark, [(x,) for x in logs], "l string").select(cp.failure_reason(F.col("l"))).collect()] == ["out of memory", None, None]
    assert [r[0] for r in frame(spark, [("checkpoint-20",), ("ckpt7",), ("x",)], "n string").select(cp.iteration(F.col("n"))).collect()] == [20, 7, None]


def test_transcripts(spark):
    turns = [(1, k, r[0], r[1]) for k, r in enumerate([("assistant", "A1"), ("user", "U1"), ("user", "U2"), ("assistant", "A2"), ("assistant", "A3"), ("ipython", "I3")])]
    got = transcripts.turn_pairs(frame(spark, turns, "e int, turn int, role string, text string"), "e", "turn").orderBy("turn_no").collect()
    assert [(r.said, r.observation) for r in got] == [("A1", "U1"), ("A2", ""), ("A3", "I3")]
    calls = [(1, 1, "a", True), (1, 1, "b", True), (1, 2, "a", True), (1, 3, "a", False), (1, 4, "b", True)]
    row = transcripts.recovery(frame(spark, calls, "episode int, turn int, endpoint string, failed boolean")).first()
    assert (row.n_failed, row.n_recovered, row.give_up_rate) == (4, 2, 0.5)
    events = [(1, k, *e) for k, e in enumerate([("call", "x", "f"), ("description", "x", ""), ("call", "x", "g"), ("doc", "y", "h"), ("call", "y", "h"), ("call", "y", "k")])]
    row = transcripts.documented_before(frame(spark, events, "episode int, pos int, kind string, app string, api string")).first()
    assert (row.n_calls, row.n_documented) == (4, 2)
    text = "```python\na=1\n``` then apis.mail.send(x) apis.api_docs.show(1)\n```py\nb"
    row = frame(spark, [(text,)], "t string").select(transcripts.code_blocks(F.col("t")).alias("c"), transcripts.api_calls(F.col("t")).alias("a")).first()
    assert row.c == ["a=1", "b"] and [tuple(x) for x in row.a] == [("mail", "send")]


def test_windows(spark):
    df = frame(spark, [("k", n, float(n)) for n in range(5)], "k string, n int, v double")
    assert [r.v for r in windows.rolling_mean(df, "k", "n", "v", 100, 3).collect()] == [2, 3, 4]
    runs = windows.ranges(frame(spark, [("k", n) for n in (0, 1, 2, 4)], "k string, n int"), "k", "n").orderBy("first").collect()
    assert [(r["first"], r["last"], r.n) for r in runs] == [(0, 2, 3), (4, 4, 1)]
    gate = windows.outlier_gate(frame(spark, [("k", n, v) for n, v in enumerate([1.0, 1.1, 0.9, 50.0, 1.0, 99.0])], "k string, n int, v double"), "k", "n", "v", 60.0)
    assert [r.accepted for r in gate.orderBy("n").collect()] == [True, True, True, False, True, False]


def test_files(spark, tmp_path):
    (tmp_path / "t1" / "logs").mkdir(parents=True)
    (tmp_path / "t1" / "logs" / "episode.json").write_text(json.dumps({"experiment_name": "e", "n_no_code_found": 2, "n_execution_failed": -1}, indent=1))
    row = files.read_episodes(spark, f"{tmp_path}/*/logs/*.json", multiline=True).first()
    assert (row.task_id, row.cancelled, row.n_execution_failed, row.n_no_code_found) == ("t1", False, None, 2)
    (tmp_path / "eval.json").write_text(json.dumps({"individual": {"a_1": {"success": True, "difficulty": 1, "num_tests": 2, "passes": [{"requirement": "r"}]}}, "aggregate": {}}))
    row = files.read_evaluation(spark, f"{tmp_path}/eval.json").first()
    assert (row.task_id, row.success, len(row.passes), row.failures) == ("a_1", True, 1, None)
    lines = frame(spark, [(1, "2024 TGC: 1 SGC: 2"), (2, "2025 TGC: 31.5 SGC: x"), (3, " ")], "n int, value string")
    assert list(files.read_result_line(lines, ["TGC", "SGC", "TGC_1"], "n").first()) == [31.5, None, None]
    listing = frame(spark, [("checkpoint-3", "done.txt"), ("checkpoint-4", "trainer_state.json"), ("checkpoint-5", "trainer_state.json"), ("checkpoint-5", "adapter_model.bin")], "folder string, name string")
    assert sorted(r.iteration for r in files.complete_checkpoints(listing).collect()) == [3, 5]


def test_gate(spark, tmp_path):
    gate = batches.Gate(spark, str(tmp_path / "m"))
    assert gate.begin(1, 144) == 0
    with pytest.raises(ValueError):
        gate.commit(1, 143)
    assert gate.begin(1, 144) == 1
    gate.commit(1, 144)
    gate.assert_committed(1)
    gate.begin(2, 10)
    gate.abort(2, "memory")
    with pytest.raises(ValueError):
        gate.assert_committed(2)
    done = frame(spark, [(7,)], "iteration int")
    assert [r.iteration for r in batches.orphans(gate.current(), done).collect()] == [1]
    assert gate.history().count() == 5


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.token_id(F.lit("token_id:31"))) == 31
    with pytest.raises(Exception, match="not a token id"):
        one(scalars.token_id(F.lit("token:31")))
    assert [one(scalars.scheme(F.lit(u))) for u in ("s3:/b/k", "s3://b/k", "/tmp/x", "a/b")] == ["s3", "s3", "file", "file"]
    parts = one(scalars.template_parts(F.lit("intro\nUSER: hello\nthere\nASSISTANT: hi")))
    assert [(p.role, p.text.strip()) for p in parts] == [("user", "hello\nthere"), ("assistant", "hi")]
    assert [one(scalars.cut_at_break(F.lit(t), 8, "...")) for t in ("short", "one two three", "one\ntwo three", "abcdefghijkl")] == ["short", "one two...", "one...", "abcdefgh..."]
    assert one(scalars.short_model(F.lit("org/Model-32B-Instruct-v2"))) == "Model-32B"
    assert one(scalars.safe_float(F.lit("x"))) is None and one(scalars.runners(F.lit(5), F.lit(2), F.lit(3))) == 9
    df = frame(spark, [([(1.0, True), (3.0, False), (2.0, True), (2.0, True)],), ([(1.0, False)],)], "c array<struct<reward:double,valid:boolean>>")
    assert [r[0] for r in df.select(scalars.best_candidate(F.col("c"))).collect()] == [2, 0]


@pytest.mark.parametrize("most,most_message,recent", [(120, 60, 3), (80, 40, 2), (60, 5, 4), (0, 1, 0), (10_000, 50, 2)])
def test_history_that_has_to_fit(spark, most, most_message, recent):
    rng = random.Random(most)
    roles = ["assistant", "user", "ipython", "system"]
    talks = {c: [(rng.choice(roles[: 2 + c % 3]), None if rng.random() < 0.1 else "é" * rng.choice([0, 3, 30, 70])) for _ in range(rng.randint(0, 9))] for c in range(40)}
    want = []
    for c, talk in talks.items():
        seen = "ipython" if any(r == "ipython" for r, _ in talk) else "user"
        kept = [[i, r, t] for i, (r, t) in enumerate(talk)]
        body, size = kept[1:], lambda x: sum(len(t or "") for _, _, t in x)
        for at, one in enumerate(body):
            if size(body) > most and at < len(body) - recent and one[1] == seen:
                one[2] = transcripts.OMITTED
            elif size(body) <= most:
                break
        for one in body:
            if size(body) <= most:
                break
            if one[1] == seen and len(one[2] or "") > most_message:
                one[2] = one[2][: max(1, most_message - len(transcripts.CUT))] + transcripts.CUT
        while size(body) > most and len(body) > recent:
            body = body[1:]
        want += [(c, *one) for one in kept[:1] + body]
    rows = [(c, i, r, t, 1) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    frame = spark.createDataFrame(rows, "conv int, turn int, role string, text string, rest int")
    got = transcripts.truncated_history(frame, "conv", "turn", most=most, most_message=most_message, recent=recent)
    assert got.columns == frame.columns
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want, key=lambda x: x[:2])


def test_tokens_of_a_named_vocabulary(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    plain = Tokenizer.from_file(path)
    size = lambda t: len(plain.encode(t, add_special_tokens=False))
    texts = ["", None, "Zwölf Äpfel\nand more", "word " * 80, "line\n" + "x y " * 60, "é" * 200, "short"]
    df = frame(spark, [(i, "user", t) for i, t in enumerate(texts)], "k int, role string, text string")
    out = df.select("k", tokenizers.message_size(spark, path, F.col("role"), F.col("text")).alias("n"), tokenizers.cut_to_tokens(spark, path, F.col("text"), 50).alias("cut"))
    got = {r.k: r for r in out.collect()}
    for k, t in enumerate(texts):
        assert got[k].n == size(t or "") + size("user") + size("\n\n") + 2
        if t is None or size(t) <= 20:
            assert got[k].cut == t
            continue
        kept = got[k].cut.removesuffix(tokenizers.NOTICE)
        assert kept != got[k].cut and t.startswith(kept) and size(kept) <= 20
    assert got[3].cut.startswith("word word")
    assert got[4].cut == "line" + tokenizers.NOTICE


def test_code_and_calls(spark):
    texts = {
        "a ```python\nx\n``` b ```PY y``` c ```py\n z": ["x", "y", "z"],
        "```python a ```python b```": ["a"],  # the second fence closes the first; what is left opens none
        "``` python```": [],
        "```py \n ": [],
        "none": [],
    }
    for t, want in texts.items():
        assert spark.range(1).select(transcripts.code_blocks(F.lit(t))).first()[0] == want, t
    text = lambda t: spark.range(1).select(transcripts.code_text(F.lit(t))).first()[0]
    assert text("```python\n a ``` and ```py b") == "a\nb" and text("```PYTHON a```") == "" and text("") == ""
    code = "apis.api_docs.show_api_doc(app_name='m', api_name=\"send\")\nx = apis.m.send (1)\napis.api_docs.show_api_descriptions(app_name='k')\napis.api_docs.show_api_doc(app_name='m')\nmyapis.m.x()\napis.k.go(apis.k.get("
    events = spark.range(1).select(transcripts.code_events(F.lit(code))).first()[0]
    assert [tuple(e) for e in events] == [("doc", "m", "send"), ("call", "m", "send"), ("description", "k", ""), ("call", "k", "go"), ("call", "k", "get")]
    assert [tuple(c) for c in spark.range(1).select(transcripts.api_calls(F.lit(code))).first()[0]] == [("m", "send"), ("k", "go"), ("k", "get")]


def test_text_values_of_any_type(spark):
    df = frame(spark, [({"a": ["x", None, "y"], "b": (1, {"k": "z"}), "c": None},)], "v struct<a:array<string>,b:struct<n:int,m:map<string,string>>,c:string>")
    assert df.select(transcripts.text_values(F.col("v"), df.schema["v"].dataType)).first()[0] == ["x", "y", "z"]


def test_behaviour_of_an_episode_without_turns(spark):
    from tallyloom.operators import behaviour
    from tallyloom.sources.files import EPISODE

    rows = [{"experiment_name": "e", "eval_result": {"success": None, "num_interactions": 4}}, {"experiment_name": "e", "chat_history": [{"role": "assistant", "content": None}]}]
    df = spark.read.schema(EPISODE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    df = df.select(F.col("experiment_name").alias("experiment"), F.monotonically_increasing_id().cast("string").alias("task_id"), "*")
    row = behaviour.behaviour(df).first()
    assert (row.num_rollouts_analyzed, row.num_turns_avg, row.average_partial_pass_rate, row.failed_api_call_give_up_rate) == (2, 2.5, 0.0, 0.0)
    assert behaviour.summary(behaviour.episode_values(df)).first().avg_num_interactions == 4


def test_aligned_tokens(spark):
    rows = [(0, True, None, [1, 2], [7, 9], [-0.5, -0.25], True), (1, True, None, [1], [7, 8], [-1.0, -2.0], True), (2, True, None, [1], [], [], False), (3, False, [5, 6], None, None, None, None)]
    df = frame(spark, rows, "n int, policy boolean, message_tokens array<int>, prompt_tokens array<int>, generated_tokens array<int>, generated_logprobs array<double>, stopped boolean")
    got = tokens.aligned(df, [8, 9], 9, [3]).orderBy("n").collect()
    assert [r.tokens for r in got] == [[1, 2, 7, 9, 3], [1, 7, 8, 3], [1, 9, 3], [5, 6]]
    assert [r.is_output for r in got][0] == [False, False, True, True, False] and [sum(r.is_output) for r in got] == [2, 2, 0, 0]
    assert all(len(r.tokens) == len(r.log_probs) for r in got) and [x for x in got[0].log_probs if x == x] == [-0.5, -0.25]
    cut = frame(spark, [([1],)], "generated_tokens array<int>").withColumns({"policy": F.lit(True), "message_tokens": F.lit(None).cast("array<int>"), "prompt_tokens": F.lit(None).cast("array<int>"), "stopped": F.lit(True), "generated_logprobs": F.array(F.lit(-1.0))})
    assert tokens.aligned(cut, [8, 9], 9, [3]).first().tokens == [1, 9, 3]


def test_drift_is_an_error(spark):
    df = frame(spark, [(1, [-1.0], [-1.1], [True]), (2, [-1.0], [-3.0], [True])], "k int, old_lp array<double>, new_lp array<double>, is_output array<boolean>")
    assert [r.k for r in tokens.drifted(df, 0.5).collect()] == [2]
    assert tokens.no_drift(df, "k", 5.0).count() == 2
    with pytest.raises(Exception, match="differ by more than 0.5 in 2"):
        tokens.no_drift(df, "k", 0.5).collect()


def test_places_and_parts(spark):
    from tallyloom.operators.order import parted, placed_in_groups, positioned

    df = frame(spark, [(k % 3, (k * 7) % 20) for k in range(20)], "g int, v int").repartition(5)
    assert [r.pos for r in positioned(df, [F.col("v").desc()]).orderBy(F.col("v").desc()).collect()] == list(range(20))
    assert {(r.g, r.pos) for r in placed_in_groups(df, ["g"], [F.col("v")]).collect()} == {(k % 3, k // 3) for k in range(20)}
    assert positioned(df.limit(0), [F.col("v")]).count() == 0
    for n, parts in ((20, 8), (16, 8), (3, 8), (0, 2)):
        got = [r[0] for r in spark.range(n).select(parted(F.col("id"), F.lit(n).cast("long"), parts)).collect()]
        assert got == [k for k in range(parts) for _ in range(n // parts + (k < n % parts))]


def test_names_with_ranges(spark):
    names = ["m.layers.0.q", "m.layers.1.q", "m.layers.2.q", "m.layers.4.q", "m.layers.0.k", "m.norm", "head"]
    got = windows.grouped_names(frame(spark, [("a", n) for n in names] + [("b", "x.1")], "k string, n string"), "k", "n").collect()
    assert {(r.k, r.names) for r in got} == {("a", "m.layers.[0-2,4].q"), ("a", "m.layers.0.k"), ("a", "m.norm"), ("a", "head"), ("b", "x.1")}


def test_gate_lets_one_of_two_win(spark, tmp_path):
    one, two = (batches.Gate(spark, str(tmp_path / "m")) for _ in range(2))
    one.begin(1, 10)
    state = two._state(1)
    one.commit(1, 10)
    with pytest.raises(ValueError, match="there already"):
        two._publish(1, state.attempt, "end", status="aborted", expected=10, finished=0)
    assert two.current().first().status == "committed"


def test_tables_belong_to_their_run(spark):
    from tallyloom import storage

    mine = storage.materialise(spark.range(3), "mine")
    with storage.run("other"):
        other = storage.materialise(spark.range(4), "other")
    storage.release(spark, "other")
    assert mine.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(other.inputFiles()[0] if other.inputFiles() else "gone").count()


def test_files_of_runs(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "f").write_text("x")
    tasks = frame(spark, [("a",)], "task_id string")
    assert files.publish(spark, tasks, str(tmp_path / "src"), str(tmp_path / "to")) == 1 and (tmp_path / "to" / "a" / "f").read_text() == "x"
    with pytest.raises(ValueError, match="already installed: a"):
        files.publish(spark, tasks, str(tmp_path / "src"), str(tmp_path / "to"))
    assert files.remove(spark, tasks, str(tmp_path / "to")) == 1 and not (tmp_path / "to" / "a").exists()
    (tmp_path / "state.json").write_text('{"iterations_completed": 1, "global_step": 2}')
    with pytest.raises(Exception, match="output_tokens_generated, rollouts_generated"):
        files.read_state(spark, str(tmp_path / "state.json")).collect()
    rows = frame(spark, [(1, "x")], "a int, b string")
    files.write_table([rows, rows.drop("b").withColumn("c", F.lit(2))], str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).columns == ["a", "b", "c"]
    files.write_once(rows, str(tmp_path / "once"))
    files.write_once(rows.union(rows), str(tmp_path / "once"))
    assert spark.read.json(str(tmp_path / "once")).count() == 1


def test_plug_ins(spark):
    from tallyloom.operators import plugins

    known = plugins.Registry()

    @known.add("twice")
    def twice(by):
        return lambda df: df.agg((F.sum("v") * by).alias("value")).select(F.lit("sum").alias("name"), "value")

    df = frame(spark, [(1.0,), (2.0,)], "v double")
    mean = plugins.opaque_summary("mean", lambda parts: (lambda v: sum(v) / len(v))([x for p in parts for x in p["v"]]), ["v"])
    assert {tuple(r) for r in plugins.apply_summaries(df, {"a": known.make("twice", by=2), "b": mean}).collect()} == {("a", "sum", 6.0), ("b", "mean", 1.5)}
    with pytest.raises(ValueError):
        known.make("none")
    assert [r[0] for r in frame(spark, [("abc",), (None,)], "a string").select(plugins.scored(F.col("a"), len)).collect()][0] == 3.0
    plugins.register_functions(spark)
    assert tuple(spark.sql("SELECT safe_min(null, 2), safe_div(1, 0), compact('a b'), slug('__a b!')").first()) == (2.0, None, "ab", "a_b")
    calls = []

    class Mine(plugins.Hooks):
        def before_iteration(self, number):
            calls.append(("before", number))

        def after_iteration(self, number, batch):
            calls.append(("after", number, batch.count()))

    plugins.hooked(lambda batch, n: calls.append(("put", n)), [Mine()])(df, 7)
    assert calls == [("before", 7), ("put", 7), ("after", 7, 2)]


def test_options_and_splits():
    assert cp.allowed_split("dev") == "dev" and cp.allowed_split("test_normal", True) == "test_normal"
    assert cp.sampling_options(top_p=None, temperature=1.0)["temperature"] == 1.0
    for bad in (lambda: cp.allowed_split("test_normal"), lambda: cp.sampling_options(top_k=3)):
        with pytest.raises(ValueError):
            bad()


def test_paths_and_uploads(spark, tmp_path):
    from tallyloom.sources import paths

    base = f"file://{tmp_path}"
    paths.make_folder(spark, f"{base}/a/b")
    paths.write_bytes(spark, f"{base}/a/b/x.txt", b"one")
    paths.write_bytes(spark, f"{base}/a/b/x.txt", b"two")
    with pytest.raises(FileExistsError):
        paths.write_bytes(spark, f"{base}/a/b/x.txt", b"three", overwrite=False)
    assert paths.read_bytes(spark, f"{base}/a/b/x.txt") == b"two" and paths.children(spark, f"{base}/a/b") == ["x.txt"] and paths.children(spark, f"{base}/none") == []
    batches.upload(spark, f"{base}/a/b", f"{base}/checkpoint-7")
    assert paths.children(spark, f"{base}/checkpoint-7") == ["done.txt", "x.txt"]
    assert [p.rsplit("/", 1)[1] for p in paths.glob(spark, f"{base}/check*")] == ["checkpoint-7"]
    assert files.last_checkpoint(files.complete_checkpoints(files.listing(spark, f"{base}/checkpoint-7"))).first().iteration == 7
    assert paths.delete(spark, f"{base}/a") and not paths.exists(spark, f"{base}/a") and not paths.delete(spark, f"{base}/a")


def test_watch_evaluates_what_waited(spark, tmp_path):
    source, seen, results = (str(tmp_path / n) for n in ("source", "seen", "results"))
    open_, told = [False], []

    def poll():
        stream = spark.readStream.schema("name string").json(source).filter(cp.due(F.col("name"), 10))
        done = lambda: frame(spark, [(n,) for n in told], "name string")
        batches.watch(stream, seen, results, ["name"], done, lambda: open_[0], lambda rows: told.extend(sorted(r.name for r in rows.collect()))).awaitTermination()

    add = lambda *names: frame(spark, [(n,) for n in names], "name string").write.mode("append").json(source)
    add("checkpoint-10", "checkpoint-15")
    poll()
    assert told == []
    open_[0] = True
    add("checkpoint-20")
    poll()
    assert told == ["checkpoint-10", "checkpoint-20"]


def test_yaml_of_rollouts(spark):
    pytest.importorskip("yaml")
    from tallyloom.sources import yaml_rollouts

    text = "cancelled: true\nelapsed: 2\nmessages:\n- !!python/object:a.b.PolicyMessage\n  role: assistant\n  content: 'x: y'\n  generated_tokens: [1, 2]\n  generated_token_logprobs: [-0.5, .nan]\npolicy_token_info: !!python/object:a.Info\n  tokens: [1]\nappworld_rollout_data:\n  task:\n    task_id: a_1\n  num_prompt_messages: 3\n"
    df = frame(spark, [(text,), (None,)], "t string").select(yaml_rollouts.parsed(F.col("t")).alias("r"))
    r = [x.r for x in df.collect() if x.r][0]
    assert (r.cancelled, r.elapsed, r.messages[0].content, r.messages[0].generated_tokens, r.policy_token_info.tokens) == (True, 2.0, "x: y", [1, 2], [1])
    assert (r.appworld_rollout_data.num_prompt_messages, r.appworld_rollout_data.n_no_code_found) == (3, -1)
    again = df.filter("r.elapsed IS NOT NULL").select(yaml_rollouts.parsed(yaml_rollouts.written(F.col("r"))).alias("r")).first().r
    assert again.messages[0].content == "x: y"
    e = yaml_rollouts.episodes(df.filter("r.elapsed IS NOT NULL"), "r", "e").first()
    assert (e.task_id, e.cancelled, e.n_execution_failed) == ("a_1", False, -1)


def test_latest_file_and_log_tail(spark, tmp_path):
    import os

    for k, name in enumerate(("iteration-000002.json", "iteration-000001.json", "other.txt")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    found = files.latest_file(files.listing(spark, str(tmp_path)), r"^iteration-\d+\.json$").first().path
    assert found.endswith("iteration-000001.json")
    assert spark.range(1).select(cp.log_tail(F.lit("abcdef"), 3)).first()[0] == "def"


def test_throughput_in_double_seconds_as_its_sql(spark, tmp_path):
    import duckdb
    from tallyloom.plans import registry

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT k * 100000 AS event_id, TIMESTAMP '2024-01-01 00:01:09.385530' + to_microseconds(CAST(k * 7919 AS BIGINT)) AS ts, 'click' AS event_type FROM range(20) t(k)
      UNION ALL SELECT 7, NULL, 'click' UNION ALL SELECT 9, TIMESTAMP '2024-01-02', NULL UNION ALL SELECT NULL, TIMESTAMP '2024-01-01 00:30:00', 'click') TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    shown = lambda rows: sorted(map(repr, rows))
    got = registry.queries()["throughput_window"](spark, str(tmp_path)).select("event_type", "t", "per_second").collect()
    assert shown(map(tuple, got)) == shown(con.execute(registry.oracle_sql()["throughput_window"]).fetchall())


@pytest.mark.parametrize("seconds", [1, 40, 5000])
def test_throughput_of_a_key_in_many_partitions(spark, seconds):
    rng = random.Random(seconds)
    rows = [(k, float(rng.randint(0, 3000)), rng.randint(0, 9)) for k in ("a", "b") for _ in range(300)] + [(None, 5.0, 1), (None, 6.0, 3), ("c", 1.0, None), ("c", 2.0, 4)]
    frame = spark.createDataFrame(rows, "k string, s double, v int").withColumn("at", F.timestamp_seconds("s"))
    out = windows.throughput(frame.repartition(5), "k", "at", "v", seconds)
    # a frame of a range holds all rows of a window, and a key's window one task
    assert "RangeFrame" not in out._jdf.queryExecution().toString()
    assert len({r[0] for r in out.select(F.spark_partition_id()).collect()}) > 1

    def wanted():
        for key in {r[0] for r in rows}:
            own = sorted(((s, v) for k, s, v in rows if k == key), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
            for n, (s, v) in enumerate(own):
                first = next(x for x in own if x[0] >= s - seconds)
                start = first if first[0] < s else own[n - 1] if n else None
                yield key, s, v, None if start is None or None in (v, start[1]) else (v - start[1]) / max(s - start[0], 1e-8)

    assert sorted(map(repr, (tuple(r) for r in out.select("k", "s", "v", "per_second").collect()))) == sorted(map(repr, wanted()))


def test_archives_in_pieces_that_the_driver_does_not_see(spark, tmp_path, monkeypatch):
    import io
    import zipfile

    rng = random.Random(5)
    rows = [(k % 3, f"é{k:06}\n.yaml", None if k % 50 == 0 else rng.randbytes(4000 if k % 3 else 2).hex()) for k in range(1500)] + [(7, f"{k}", "") for k in range(70_000)]
    frame = spark.createDataFrame(rows, "rank int, member string, text string").repartition(4)
    monkeypatch.setattr(type(frame), "toLocalIterator", lambda *a, **b: pytest.fail("archives came to the driver"))
    path = f"{tmp_path}/archives"
    files.write_archives(frame, path)
    assert sorted(x.name for x in tmp_path.glob("archives/r*")) == ["r0.zip", "r1.zip", "r2.zip", "r7.zip"]
    want = sorted((r, m, t or "") for r, m, t in rows)
    with_zipfile = []
    for x in tmp_path.glob("archives/*.zip"):
        with zipfile.ZipFile(x) as z:
            with_zipfile += [(int(x.stem[1:]), n, z.read(n).decode()) for n in z.namelist()]
    assert sorted(with_zipfile) == want
    files.write_archives(frame.filter("rank = 1").withColumn("text", F.lit("again")), path)
    assert sorted(map(tuple, files.archive_members(spark, path).collect())) == sorted((r, m, "again" if r == 1 else t) for r, m, t in want)

    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.comment = b"a comment"
            for _, name, text in want[:200]:
                z.writestr(name, text)
            with z.open("wide", "w", force_zip64=True) as f:
                f.write(b"x" * 1000)
        own = tmp_path / f"r{method}.zip"
        own.write_bytes(b"before" + out.getvalue())
        assert sorted(map(tuple, files.archive_members(spark, str(own)).collect())) == sorted([(method, n, t) for _, n, t in want[:200]] + [(method, "wide", "x" * 1000)])
