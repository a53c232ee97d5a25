import random
from collections import Counter

import numpy as np

from tallyloom.llm import near_duplicates as nd
from tallyloom.llm.components import components
from tallyloom.llm.text import words


def multiset(text):
    w = words(text.encode())
    return Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return (a & b).total() / (a | b).total() if a or b else 1.0


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_registers_agree_with_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    b[:45] = a[:45]
    a[0] = b[0] = 1000
    a[1], b[1] = 300, 500
    docs = np.concatenate([np.zeros(int((a > 0).sum())), np.ones(int((b > 0).sum()))]).astype(np.int64)
    out = nd.signatures(docs, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 20000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert np.isfinite(out).all() and abs((out[0] == out[1]).mean() - want) < 0.015


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    rows = components(spark.createDataFrame(links, "a long, b long"), "t").collect()
    want = closed({x for p in links for x in p}, links)
    assert {r.node: r.component for r in rows} == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 2)
    monkeypatch.setattr(nd, "MATRIX_COLUMNS", 50)
    rng = random.Random(3)
    line = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    docs = []
    for _ in range(25):
        base = line(rng.choice([3, 8, 60, 150]))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "z"])
            docs.append(" ".join(w))
    docs += [docs[0].upper() + " !", docs[1], None, None, "", " -- ", "one", "ONE"] + ["again and again and " * k for k in (10, 10, 11, 30)]
    rows = list(enumerate(docs)) + [(0, docs[0]), (3, "a row with an id seen before and other words in it")]
    got = nd.classes(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, bands string")).collect()
    sets = {k: None if t is None else multiset(t) for k, t in enumerate(docs)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] is not None and sets[b] is not None and similarity(sets[a], sets[b]) >= 0.8]
    want = closed(sets, links)
    assert {(r.doc_id, r.class_id) for r in got} == {(k, c) for k, c in want.items()} | {(3, 3)}
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(set(want.values())) + 1
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_follow_words_in_pieces(monkeypatch):
    from tallyloom.llm import text

    texts = [None, "", " - ", "Ein Wort", "A b\tc" * 50, "ünï çödé 漢字 x" * 9, "y" * 300 + " z", "αβγ " * 40]
    number = {}
    whole = [text.word_hashes(None if t is None else t.encode()) for t in texts]
    for t, h in zip(texts, whole):
        own = words(None if t is None else t.encode())
        assert len(own) == len(h) and all(number.setdefault(w, x) == x for w, x in zip(own, h.tolist()))
    assert len(set(number.values())) == len(number)
    monkeypatch.setattr(text, "PIECE", 7)
    assert all((text.word_hashes(None if t is None else t.encode()) == h).all() for t, h in zip(texts, whole))


def test_very_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nd, "SLICE", 1000)
    rng = random.Random(5)
    long = [f"v{rng.randint(0, 10**6)}" for _ in range(60_000)]
    near = [w if k % 400 else "changed" for k, w in enumerate(long)]
    got = nd.classes(spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:40_000]))], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
