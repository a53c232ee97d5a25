import random
import zlib
from collections import defaultdict

import hashlib
import pytest

from tallyloom.llm.mixing import mix
from tallyloom.llm.sharding import shards


def least_capacity(sizes, n):
    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        c, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used, at + s) if at + s <= c else (used + 1, s)
        low, high = (low, c) if used <= n else (c + 1, high)
    return low


@pytest.mark.parametrize("grid", [1, 2048])
@pytest.mark.parametrize("hot", [0, 150])
def test_minimax(spark, monkeypatch, grid, hot):
    monkeypatch.setattr("tallyloom.llm.sharding.GRID", grid)
    rng = random.Random(hot)
    docs = [(k, "é" * rng.randint(0, 40) + str(rng.randint(0, 300))) for k in range(400)] + [(1000 + k, "copy of a text") for k in range(hot)]
    docs += [(2000, None), (2001, None), (2002, ""), (2003, ""), (5, docs[5][1]), (None, "null id")]
    rows = shards(spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, size int, pos string")).collect()
    assert len(rows) == len(docs)
    texts = defaultdict(list)
    for k, t in docs:
        texts[k].append(t)
    size = lambda t: len((t or "").encode()) + 1
    groups = defaultdict(int)
    for k, t in docs:
        groups[hashlib.sha256((f"null {k}" if t is None else t).encode()).digest()] += size(t)
    best = least_capacity([groups[k] for k in sorted(groups)], 16)
    by, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id][0]
        assert r["size"] == size(t) and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
        if t is not None:
            of_text[t].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert set(by) <= set(range(16))
    assert max(sum(r["size"] for r in own) for own in by.values()) == best
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def test_shards_of_nothing(spark):
    assert shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def filled(sizes, weights, most):
    total, targets, capped = sum(sizes), {}, set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        level = (total - sum(most * sizes[k] for k in capped)) / sum(weights[k] for k in free) if free else 0
        over = {k for k in free if level * weights[k] >= most * sizes[k]}
        targets = {k: most * sizes[k] if k in capped else level * weights[k] for k in range(len(sizes))}
        if not over:
            return [targets[k] for k in range(len(sizes))]
        capped |= over


def test_mix(spark):
    rng = random.Random(3)
    sources = ["a", "B", "é", "zz", "", None]
    docs = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(sources[:1] * 9 + sources)) for k in range(900)]
    docs += [(5000, None, "zz"), (5001, "", None), (7, "again \t\x0b one", "a"), (6000, "huge " * 400, "tiny")]
    quality = spark.createDataFrame([(k, k % 2) for k in range(0, 900, 3)] + [(0, 1), (3, None)], "doc_id long, quality int")
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, source string, size int")
    rows = mix(d, quality).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(d.repartition(3), quality).collect()))
    assert len(rows) == len(docs)
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, s in docs:
        total[s] += len((text or "").split())
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, filled([total[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)))
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == total[r.source] and r.taken <= 3 * r["size"] and r.taken == r.times * r["size"]
    assert target == pytest.approx(want)
    longest = {s: max([len((t or "").split()) for _, t, x in docs if x == s]) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)


def test_mix_prefers_quality_and_takes_empty_tables(spark):
    d = spark.createDataFrame([(k, "one two", "a") for k in range(2000)] + [(9000 + k, "w", "b") for k in range(2500)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(k, k % 2) for k in range(2000)], "doc_id long, quality int")
    rows = [r for r in mix(d, quality, weights=(1, 4)).collect() if r.source == "a"]
    good = sum(r.taken for r in rows if r.doc_id % 2)
    assert good > 1.2 * sum(r.taken for r in rows if r.doc_id % 2 == 0)
    assert mix(d.limit(0), quality).count() == 0


@pytest.mark.parametrize("tail", [10**6, 0])
def test_mix_goes_on_behind_a_document_that_does_not_fit(spark, monkeypatch, tail):
    monkeypatch.setattr("tallyloom.llm.mixing.TAIL", tail)
    rng = random.Random(8)
    docs = [(1000 * s + k, "w " * rng.randint(10, 20), f"s{s:02d}") for s in range(24) for k in range(100)]
    docs += [(1000 * s + 500, "long " * 750, f"s{s:02d}") for s in range(24)]  # a third of its source's words
    taken, target = defaultdict(int), {}
    for r in mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    # every third source has 0.375 of its words left to give, for which its short documents suffice
    assert all(abs(taken[s] - target[s]) <= 20 for s in sorted(target)[2::3])
