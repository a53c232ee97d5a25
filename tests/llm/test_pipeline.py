from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_near_duplicates import closed, multiset, similarity


def write(spark, frame, path):
    frame.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_match_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90000, None, "en", "src0", 0), (90001, "12 34 --", None, "src1", 8), (None, "the rain and the of that", None, None, 24)], docs.schema)
    docs = write(spark, docs.union(extra), tmp_path / "in")
    kept = write(spark, cp.identify(spark, docs, sf), tmp_path / "0")
    before, after = {r.doc_id for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    assert kept.columns == list(cp.COLUMNS) and before - set(after) == {90000, 90001}
    single = write(spark, cp.deduplicate(spark, kept, sf), tmp_path / "1")
    sets = {k: multiset(r.text) for k, r in after.items()}
    ids = sorted(sets, key=lambda k: (k is None, k or 0))
    rank = {k: n for n, k in enumerate(ids)}
    links = [(rank[a], rank[b]) for a in ids for b in ids if rank[a] < rank[b] and similarity(sets[a], sets[b]) >= 0.8]
    assert sorted(rank[r.doc_id] for r in single.collect()) == sorted(set(closed(range(len(ids)), links).values()))
    clean = write(spark, cp.decontaminate(spark, single, sf), tmp_path / "2")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = contaminated([(r.doc_id, r.text) for r in single.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {k for k, v in hits.items() if not v[1]}
    mixed = write(spark, cp.mix(spark, clean, sf), tmp_path / "3")
    rows, sources = mixed.collect(), Counter()
    assert mixed.columns == list(cp.COLUMNS) and max(Counter(r.doc_id for r in rows).values()) <= 3
    text = {r.doc_id: r.text for r in clean.collect()}
    assert all(text[r.doc_id] == r.text for r in rows)
    total = sum(len(t.split()) for t in text.values())
    assert abs(sum(len(r.text.split()) for r in rows) - total) <= 0.2 * total
    placed = cp.shard(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in rows)
    assert len({(r.shard, r.slot) for r in placed}) == len(rows)


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "shard" in out.columns
