import numpy as np
import pyarrow.dataset as ds
import pytest

from tallyloom.llm import embeddings


def brute(ids, vectors, threshold=0.9):
    ok = [k for k, v in enumerate(vectors) if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[k] for k in ok], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= threshold
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    n = [0] * len(ids)
    for a, b in zip(*np.nonzero(close)):
        if a != b:
            n[ok[a]] += 1
            parent[root(ok[a])] = root(ok[b])
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, n[k], least[root(k)], least[root(k)] == i) for k, i in enumerate(ids))


@pytest.mark.parametrize("codewords,block", [(1, 256), (6, 7)])
def test_links_match_brute_force(spark, monkeypatch, codewords, block):
    monkeypatch.setattr(embeddings, "CODEWORDS", codewords)
    monkeypatch.setattr(embeddings, "VECTORS_EACH", 5)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    vectors = [(c + rng.normal(size=8) * 0.08).astype(np.float32).tolist() for c in centres for _ in range(8)]
    vectors += [vectors[0]] * 20 + [[2 * v for v in vectors[5]], None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0] * 3, [1e-30] * 8, [1e30] * 8]
    ids = list(range(100, 100 + len(vectors)))
    frame = spark.createDataFrame([(i, v, "k") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, key string").repartition(3)
    got = sorted(tuple(r) for r in embeddings.linked(frame).collect())
    want = brute(ids, vectors)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert codewords > 1 or got == want


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    got = {r.vec_id: r.n_links for r in embeddings.linked(spark.read.parquet(path)).collect()}
    t = ds.dataset(path).to_table().to_pandas()
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= n for i, n in zip(t.vec_id, want))


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.linked(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.linked(spark.createDataFrame([(4, None)], schema)).collect()] == [(4, 0, 4, True)]


def test_traversal_is_by_distance():
    rng = np.random.default_rng(0)
    index = embeddings.MultiIndex(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)))
    x = rng.normal(size=(6, 6))
    a, b = index.distances(x)
    for k, order in enumerate(index.visits(x, 20)):
        sums = [a[k, c // 4] + b[k, c % 4] for c in order]
        assert sorted(order) == list(range(20)) and sums == sorted(sums) and order[0] == index.cell(x)[k]


def test_sparse_pairs_and_a_hot_group_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "VECTORS_EACH", 40)
    monkeypatch.setattr(embeddings, "PROBE_VECTORS", 20)
    rng = np.random.default_rng(11)

    def partner(v, cosine):
        side = rng.normal(size=8)
        side -= side @ v / (v @ v) * v
        return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)

    # the codebooks are fitted on other vectors than the pairs, so that no probe has a link
    many = rng.normal(size=(3000, 8))
    left, right = embeddings._codebook(many[:, :4], 12, 1), embeddings._codebook(many[:, 4:], 12, 2)
    some = rng.normal(size=(150, 8))
    vectors = [*some, *(partner(v, c) for v in some[:60] for c in (0.905, 0.95))]
    vectors += [many[0] / np.linalg.norm(many[0]) + rng.normal(size=8) * 0.05 for _ in range(300)]
    vectors = [v.tolist() for v in vectors]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    want = brute(list(range(len(vectors))), vectors)
    assert sorted(tuple(r) for r in embeddings.linked(frame, index=embeddings.MultiIndex(left, right)).collect()) == want
    assert sorted(tuple(r) for r in embeddings.linked(frame).collect()) == want


def test_each_length_links_by_itself(spark):
    vectors = [[1.0, 0.0, 0.0, 0.1], [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [1.0], [3.0], [-1.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.linked(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_recall_of_pairs_just_above_the_threshold(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.97, size=(len(x), 1))
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside])
    got = {r.vec_id: r.n_links for r in embeddings.linked(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<double>")).collect()}
    want = (both @ both.T >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[k] <= n for k, n in enumerate(want))
