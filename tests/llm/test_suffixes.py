import random
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import suffixes


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((len(t), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["rain", "été", "on", "the", "x", "stone"])
    prose = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    passages = [prose(n) for n in (399, 390, 401, 450, 900, 3000)]
    out = [prose(rng.randint(0, 900)) + rng.choice(passages)[rng.randint(0, 30) :] + prose(rng.randint(0, 500)) for _ in range(60)]
    out += [prose(1) + passages[3] + prose(1) for _ in range(40)]
    out += ["a" * 399, "a" * 400, "ab" * 700, "b" * 1000, None, "", passages[5], passages[5], " ".join(word() for _ in range(2000))]
    long = prose(5000)
    return out + [long, long[:2000] + "#" + long[2001:], long[:1000] + long[1100:]]


@pytest.mark.parametrize("hot", [512, 3])
def test_removal_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    own = texts()
    rows = list(enumerate(own)) + [(1, own[1]), (2, "another text of the id 2")]
    want = brute([t for _, t in rows])
    got = suffixes.remove_repeats(spark.createDataFrame([(k, t, "k", 1) for k, t in rows], "doc_id long, text string, kept string, id int")).collect()
    shape = lambda k, n, removed, kept: (k, n, tuple(removed), kept)
    assert Counter(shape(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in got) == Counter(shape(k, *w) for (k, _), w in zip(rows, want))


def test_long_texts_go_in_pieces():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(6000))
    whole = suffixes.regions([text])
    starts = {int(p) for f, last in zip(whole[1], whole[2]) for p in range(f, last + 1)}
    assert starts == set(range(len(text) - 399))
    for a in (0, 2000):
        part = suffixes.regions([text[a : a + 3000]])
        place = {int(x) + a for x in part[3]}
        assert place <= {int(x) for x in whole[3]} and part[1][0] == 0


def test_suffix_order():
    rng = random.Random(2)
    for alphabet in (b"a", b"ab", b"abcdefghij"):
        data = bytes(rng.choice(alphabet) for _ in range(900)) * 2
        starts = np.array(sorted(rng.sample(range(len(data)), 700)))
        got = suffixes.sorted_suffixes(np.frombuffer(data, dtype=np.uint8), starts, 400)
        pad = data + b"\0" * 400
        keys = [pad[s : s + 400] for s in got]
        assert sorted(got.tolist()) == starts.tolist() and keys == sorted(keys)


def test_cover_takes_every_pair():
    inside, shift = suffixes._cover(suffixes.COVER)
    n = suffixes.COVER
    assert all(inside[(a + shift[a, b]) % n] and inside[(b + shift[a, b]) % n] for a in range(n) for b in range(n))


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [512, 3])
def test_shorter_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1500)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh éß\n") for _ in range(n))
    passages = [prose(n) for n in (200, 250, 270, 300, 380, 420)]
    own = texts() + [prose(rng.randint(0, 300)) + p + prose(rng.randint(0, 300)) for p in passages for _ in range(3)] + [passages[3], passages[4] + passages[4]]
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()
    short, long = brute(own, suffixes.SHORT), brute(own)
    assert len(got) == len(own)
    for r in got:
        assert [(s.start, s.end) for s in r.repeated] == short[r.doc_id][1]
        assert [(s.start, s.end) for s in r.removed] == long[r.doc_id][1] and bytes(r.kept) == long[r.doc_id][2]
