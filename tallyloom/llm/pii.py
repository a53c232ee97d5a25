"""Personal data: base patterns, then bootstrapped contextual extraction.  DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.storage import materialise

#: Kinds in the order in which spans of one start are listed.  A possessive form from a run's border finds
#: what the plain form finds, leftmost first, without trying each place of a long run again.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?<![0-9][0-9])(?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character holds none of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Strings that may be an identifier in the right context: groups of digits, and words around an @.
CANDIDATE = r"[0-9](?<![0-9][0-9])(?:[\x20().:-]{0,2}+[0-9])++|(?:\G|(?<![^\x00-\x20@]))[^\x00-\x20@]++@[^\x00-\x20@]++"

#: A kind that only the method finds.  Its seeds are long strings that are set as a value of one of the names.
SECRET = "secret"
NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
SECRET_SEED = r"(?<=[\"'=:\s])(?=[A-Za-z0-9_-]{20})[A-Za-z0-9_-](?<=(?i:" + "|".join(NAMES) + r")[\"']{0,1}\s{0,3}[:=]\s{0,3}[\"']{0,1}.)[A-Za-z0-9_-]++"
#: What may be a secret in the right context: eight characters or more with a letter and a digit.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{8})(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]++"
ALL_KINDS = (*KINDS, SECRET)

ROUNDS = 3
#: Different sure instances that a pattern must hold, and the confidence that it and an instance must reach.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 5, 0.7, 0.7
#: How much a string in a pattern counts against a kind whose loose shape it has, one of another shape counting 1.
UNSEEN = 0.25
LEFT, RIGHT = 48, 24

_SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost matches that don't overlap, with their place in code points and what stands around them."""

    def places(s: Column) -> Column:
        n = F.size(s["m"])
        around = F.zip_with(F.slice(s["p"], F.lit(1), n), F.slice(s["p"], F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        each = F.zip_with(s["m"], around, lambda m, p: F.struct(m.alias("m"), p["a"].alias("a"), p["b"].alias("b")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["a"])
            end = start + F.length(x["m"])
            own = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text"), F.right(x["a"], F.lit(LEFT)).alias("left"), F.left(x["b"], F.lit(RIGHT)).alias("right"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(each, start, step, lambda acc: acc["out"])

    none = F.array().cast(_SPAN)
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), text.alias("t"))
    found = _bound(whole, lambda w: F.when(F.size(w["m"]) > 0, _bound(F.struct(w["m"].alias("m"), F.split(w["t"], pattern, -1).alias("p")), places)).otherwise(none))
    return F.when(guard, found).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(_digits(text)), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the pattern counts."""

    def part(p: Column) -> Column:
        short = F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return short & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)

    tests = {
        "ip": lambda x: F.forall(F.split(x["text"], r"\."), part),
        "card": lambda x: F.length(_digits(x["text"])).between(12, 19) & _luhn(x["text"]),
        "phone": lambda x: F.length(_digits(x["text"])).between(9, 15),
    }
    return tests[kind]


def _fits(kind: Column, text: Column) -> Column:
    """Whether a string has the loose shape of a kind."""
    n = F.length(_digits(text))
    shapes = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "card": ~F.contains(text, F.lit("@")) & n.between(12, 19) & ~text.rlike("[A-Za-z]"), "phone": ~F.contains(text, F.lit("@")) & n.between(7, 15) & ~text.rlike("[A-Za-z]"), SECRET: ~F.contains(text, F.lit("@")) & text.rlike("[A-Za-z]") & (F.length(text) >= 8)}
    return reduce(lambda a, b: a | b, ((kind == k) & shape for k, shape in shapes.items()))


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an occurrence: the two words before it, and the words on either side."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    one, two = F.regexp_extract(plain(left), r"(\S+)\s*$", 1), F.regexp_extract(plain(left), r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(plain(right), r"^\s*(\S+)", 1)
    both = F.array(F.when(two != "", F.concat(F.lit("l "), two)), F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("b"), one, F.lit("_"), after)))
    return F.filter(both, lambda p: p.isNotNull())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """Spans of personal data in every whole text.

    Base spans come from ``PATTERNS``; matches that fail the limit on parts, the digit count or the
    Luhn sum are dropped without another try.  They and secrets set under one of ``NAMES`` seed the method: their
    contexts induce patterns, and a pattern is scored for a kind by the sum of its different instances' scores over
    that sum, one, all its strings of other shapes or kinds, and a quarter of those of the kind's shape that nothing tells of
    yet.  An instance's score is the noisy-or of its patterns' scores.  Every round instances that are sure support
    patterns as seeds do, so that patterns are learned from what was discovered; after ``rounds`` rounds strings of
    the loose shape of a kind in a pattern sure of that kind are spans as well.

    Returns id, ``carry`` columns, base and spans: arrays of (start, rank, end, kind) in code points,
    end exclusive, sorted by start and rank, the place of the kind in ``ALL_KINDS``.  spans has all of base.
    Null and empty texts have none; each row of a repeated id is scanned by itself; without seeds
    nothing is added.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"_c_{c}") for c in carry), text.alias("text"))
    guard = {k: F.contains(F.col("text"), F.lit(NEEDS[k])) if k in NEEDS else F.lit(True) for k in KINDS}
    scanned = chosen.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *(f"_c_{c}" for c in carry),
        *(_found(F.col("text"), PATTERNS[k], guard[k]).alias(k) for k in KINDS), _found(F.col("text"), CANDIDATE, F.lit(True)).alias("other"),
        _found(F.col("text"), SECRET_SEED, F.contains(F.col("text"), F.lit("=")) | F.contains(F.col("text"), F.lit(":"))).alias(SECRET), _found(F.col("text"), OPAQUE, F.lit(True)).alias("opaque"),
    )
    scanned = scanned.withColumns({k: F.filter(F.col(k), _valid(k)) for k in KINDS if k != "email"})
    scanned = materialise(scanned, "pii-scan")
    base = F.array_sort(F.concat(*(_ranked(k) for k in KINDS)))
    patterns, occurrences = _bootstrap(scanned, rounds)
    # a candidate that several sure patterns claim goes to the surest
    claims = occurrences.filter("kind IS NULL").withColumn("pattern", F.explode("patterns")).drop("kind").join(patterns, "pattern").filter(_fits(F.col("kind"), F.col("text")))
    best = claims.groupBy("row", "start", "end").agg(F.max(F.struct(F.col("score"), -F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")), F.col("kind"))).alias("best"))
    rank = (F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("best.kind")) - 1).cast("int")
    added = best.groupBy("row").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", F.col("best.kind").alias("kind"))).alias("added"))
    out = scanned.select("row", "doc_id", *(f"_c_{c}" for c in carry), base.alias("base"), _ranked(SECRET).alias("secrets")).join(added, "row", "left")
    spans = F.array_sort(F.array_distinct(F.concat("base", "secrets", F.coalesce("added", F.slice("base", 1, 0)))))
    return out.select(F.col("doc_id").alias(id_col), *(F.col(f"_c_{c}").alias(c) for c in carry), "base", spans.alias("spans"))


def _ranked(kind: str) -> Column:
    rank = F.lit(ALL_KINDS.index(kind))
    return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _tagged(spans: Column, kind: str | None) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x.alias("x")))


def _bootstrap(scanned: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (pattern, kind, score) and all occurrences with their patterns."""
    every = F.concat(*(F.col(k) for k in ALL_KINDS))
    free = lambda c: F.filter(c, lambda x: ~F.exists(every, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    tagged = [*(_tagged(F.col(k), k) for k in ALL_KINDS), _tagged(F.array_distinct(F.concat(free("other"), free("opaque"))), None)]
    rows = scanned.filter(F.size(every) + F.size("other") + F.size("opaque") > 0).select("row", F.explode(F.concat(*tagged)).alias("o"))
    occurrences = rows.select("row", "o.kind", "o.x.start", "o.x.end", "o.x.text", _patterns(F.col("o.x.left"), F.col("o.x.right")).alias("patterns"))
    occurrences = materialise(occurrences, "pii-occurrences")
    edges = occurrences.select(F.explode("patterns").alias("pattern"), "text", "kind").distinct()
    many = edges.groupBy("pattern").agg(F.countDistinct("text").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern")
    edges = materialise(edges.join(many, "pattern"), "pii-edges")
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "text", "kind", F.lit(1.0).alias("score"))
    unseen = edges.filter("kind IS NULL").select("pattern", "text")
    kinds = F.explode(F.array(*map(F.lit, ALL_KINDS))).alias("kind")
    # for each pattern and kind: strings of its shape without a kind, and all others, those of another kind included
    shaped = unseen.select("pattern", "text", kinds).withColumn("fits", _fits(F.col("kind"), F.col("text")))
    shapes = shaped.groupBy("pattern", "kind").agg(F.count_if("fits").alias("unseen"), F.count_if(~F.col("fits")).alias("against"))
    claimed = seeds.groupBy("pattern").agg(F.count("*").alias("all_seeds"))
    scores, patterns = seeds, None
    for turn in range(rounds):
        sums = scores.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= INSTANCE_SCORE).alias("support"), F.count_if(F.col("score") == 1.0).alias("own_seeds"))
        known = sums.filter(F.col("support") >= SUPPORT).join(shapes, ["pattern", "kind"], "left").join(claimed, "pattern", "left").na.fill(0, ["unseen", "against", "all_seeds"])
        left = F.greatest(F.col("unseen") - (F.col("support") - F.col("own_seeds")), F.lit(0))
        against = F.col("against") + F.col("all_seeds") - F.col("own_seeds") + UNSEEN * left
        sure = known.withColumn("score", F.col("s") / (F.col("s") + 1 + against)).filter(F.col("score") >= PATTERN_SCORE)
        patterns = materialise(sure.select("pattern", "kind", "score"), f"pii-patterns-{turn}")
        found = unseen.join(patterns, "pattern").filter(_fits(F.col("kind"), F.col("text"))).groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("score"))
        found = found.filter(F.col("score") >= INSTANCE_SCORE).withColumn("score", F.least("score", F.lit(0.999)))
        scores = seeds.unionByName(unseen.join(found, "text").select("pattern", "text", "kind", "score"))
    return patterns, occurrences


def count(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
