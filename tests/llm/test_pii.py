import random
import re

from tallyloom.llm.pii import detect

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    out = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return sorted(out)


def card(rng):
    d = [rng.randint(0, 9) for _ in range(15)]
    total = sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(d))
    return "".join(map(str, [*d, -total % 10]))


def test_base_matches_brute_force(spark):
    rng = random.Random(2)
    alphabet = ["a", "é", "😀", "@", ".", "-", "_", "+", " ", "1", "25", "256", "007", "(", ")", "%", "\n", "x.y", "b@c.d", "1.2.3.4", "+49 170 12345", "-"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1", "x" * 30000, "1" * 30000, "a@b" + ".c" * 20000, "+1" + "(" * 20000, "😀é card 4111 1111 1111 1111, +1 (743) 555-3824"]
    texts += [f"{card(rng)} {card(rng)[:8]}-{card(rng)}" for _ in range(50)]
    rows = detect(spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, email string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(x) for x in r.base] == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(6)
    texts = [f"Some words. please call +49 170 {rng.randint(100000, 999999)} today" for _ in range(40)]
    texts += ["Some words. please call 0170 5553824 today", "please call me", "he paid 0170 5553824 coins", "in 2024-11-12 please call 12"]
    rows = {r.doc_id: r for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(x.kind, texts[40][x.start : x.end]) for x in rows[40].spans] == [("phone", "0170 5553824")]
    assert not rows[40].base and all(not rows[k].spans for k in (41, 42, 43))
    assert all(r.spans == r.base for k, r in rows.items() if k < 40)


def test_empty_table_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string")
    assert [len(r.spans) for r in detect(frame).collect()] == [1, 1]
    assert detect(frame.limit(0)).count() == 0


def test_secrets_and_what_their_contexts_hold(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "7f"
    texts = [f'words of some kind use token = "{key(40)}" here' for _ in range(20)]
    texts += ['more words use token = "k3y-of-9" here', f"commit {key(40)} was made", "the word abcdefgh1 alone", 'password: "' + "A1_" * 10 + '"']
    rows = {r.doc_id: r for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = lambda k: [(x.kind, texts[k][x.start : x.end]) for x in rows[k].spans]
    assert all(spans(k) == [("secret", texts[k].split('"')[1])] and not rows[k].base for k in range(20))
    assert spans(20) == [("secret", "k3y-of-9")] and spans(23) == [("secret", "A1_" * 10)]
    assert not spans(21) and not spans(22)


def test_patterns_are_learned_from_what_was_discovered(spark):
    rng = random.Random(9)
    texts = [f"Some words. please call +49 170 {rng.randint(100000, 999999)} today" for _ in range(30)]
    found = [f"0170 {rng.randint(1000000, 9999999)}" for _ in range(8)]
    texts += [f"Some words. please call {n} today" for n in found]
    texts += [f"her number privately: {n} yes" for n in found]  # no seed stands in this context
    texts += ["her number privately: 0171 1234567 yes", "a price of 0171 7654321 euros"]
    rows = {r.doc_id: r for r in detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = lambda k: [(x.kind, texts[k][x.start : x.end]) for x in rows[k].spans]
    assert all(spans(30 + k) == spans(38 + k) == [("phone", n)] for k, n in enumerate(found))
    assert spans(46) == [("phone", "0171 1234567")] and not spans(47)
