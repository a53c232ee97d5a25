import itertools
import random

import numpy as np
import pytest

from tallyloom.llm import language

PARTS = {"xa": ["the", "ing", "and", "wh", "ou"], "xb": ["der", "sch", "ung", "ein", "ä"], "xc": ["ция", "при", "ов", "на"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, lang, 50), lang) for k, lang in enumerate(list(PARTS) * 60)] + [(900, None, "xa"), (901, "the the", None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_predictions_and_spans(spark, model):
    rng = random.Random(5)
    rows = [(k, text(rng, lang, 30), lang) for k, lang in enumerate(list(PARTS) * 20)]
    rows += [(800, text(rng, "xa", 20) + "\n" + text(rng, "xb", 40) + " 12 " + text(rng, "xc", 10), "xb"), (801, None, "und"), (802, "12 — !?", "und"), (803, "", "und"), (803, "", "und")]
    got = language.predict(spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double"), model, carry=("lang",)).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert all(not r.spans and r.score == 0 for r in got if r.lang_pred == "und")
    spans = next(r.spans for r in got if r.doc_id == 800)
    assert [s.lang for s in spans] == ["xa", "xb", "xc"] and spans[0].start == 0 and spans[-1].end == 71
    assert abs(spans[0].end - 20) <= 1 and abs(spans[1].end - 60) <= 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = rng.integers(0, 6, 4)
        scores, ids = rng.normal(size=(5, 3)), rng.integers(0, 5, int(counts.sum()))
        path, at = language.viterbi(scores, ids, counts, 0.7), 0
        value = lambda p, w: sum(scores[a, b] for a, b in zip(w, p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        for n in counts:
            w, p = ids[at : at + n], path[at : at + n]
            assert value(tuple(p), w) == pytest.approx(max(value(q, w) for q in itertools.product(range(3), repeat=int(n))))
            at += n


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert language.predict(empty, model).count() == 0
    rows = language.predict(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    from tallyloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
