import random
import re

from tallyloom.llm.decontamination import matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = {}
    for key, text in docs:
        w, hit, own = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                p = v[k : k + window]
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        own.add("" if item is None else str(item))
        out[key] = (len(w), len(hit), sorted(own))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "Of", "a", "été", "x9", "to", "rain"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([1, 3, 10, 14, 25]))) for k in range(12)] + [(3, "Other text of item three"), (None, "no id here"), (90, None), (91, " -- ")]
    docs = [(k, line(rng.choice([0, 5, 40, 200])) + " " + rng.choice(items)[1] if k % 3 and k < 9 else line(60)) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "OTHER--text of\nitem three, no id here"), (103, (line(300) + ". ") * 5), (104, docs[5][1])]
    d = spark.createDataFrame([(*r, "t", 7) for r in docs], "doc_id long, text string, spans string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = matches(d, b).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == brute(docs, items)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in rows)


def test_blocks_cut_and_empty_tables(spark, monkeypatch):
    docs = [(1, "Keep this. one two three four five six seven eight nine ten! And this."), (1, "one two three"), (2, None)]
    items = [(5, "one two three four five six seven eight nine ten"), (6, "AND this")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("tallyloom.llm.decontamination.BLOCK_BYTES", 20)
    rows = sorted(matches(d, b, keep_text=True).collect(), key=lambda r: (r.doc_id, -r.n_words))
    assert [(r.n_hit, r["items"], r.kept_text) for r in rows] == [(12, ["5", "6"], "Keep this. ."), (0, [], "one two three"), (0, [], None)]
    assert matches(d.limit(0), b).count() == 0
    assert {r.n_hit for r in matches(d, b.limit(0)).collect()} == {0}
