"""Language identification: script ranges, per-word scores, and Viterbi over a text's words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.text import bounded_batches, grouped, mixed, pieces, utf8

#: Documents of a language that the model is fitted on, about; chosen by a hash of the id.
TRAIN_DOCUMENTS = 20_000
#: Languages that a model can hold.
MOST_LANGUAGES = 500
#: Hash buckets for byte n-grams of 1 to 5 bytes.
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4, 5)
#: Natural-log cost of passing from one language to another between two words.
SWITCH = 10.0
#: A language uses a script if so large a share of its training words is in it.
SCRIPT_SHARE = 0.01
#: Text bytes labelled at once, with up to 8 languages; fewer with more.
TABLE_BYTES = 2_000_000
#: Different words, times languages, that are scored at once.
CHUNK = 1 << 15

#: First and last code point of script ranges (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
]
_NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ["other"]
_STARTS = [a for _, a, _ in SCRIPTS]


def _script(word: bytes) -> int:
    """Number of the script of a word's first letter, -1 if it has none."""
    if word.isascii():
        return -1 if word.isdigit() else 0
    for c in word.decode("utf-8", "replace"):
        if c.isalpha():
            at = int(np.searchsorted(_STARTS, ord(c), side="right")) - 1
            return _NAMES.index(SCRIPTS[at][0]) if at >= 0 and ord(c) <= SCRIPTS[at][2] else len(_NAMES) - 1
    return -1


def _grams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of words that stand between two spaces."""
    flat = np.frombuffer(b" " + b" ".join(distinct) + b" ", dtype=np.uint8).astype(np.uint64)
    space = flat == 32
    word = np.cumsum(space) - 1
    buckets, owner = [], []
    for n in GRAMS:
        if len(flat) < n:
            break
        code = np.full(len(flat) - n + 1, n, dtype=np.uint64)
        inner = np.zeros(len(code), dtype=bool)
        for k in range(n):
            code = code * np.uint64(257) + flat[k : len(code) + k]
            if 0 < k < n - 1:
                inner |= space[k : len(code) + k]
        keep = ~inner
        if n == 1:
            keep &= ~space
        at = np.flatnonzero(keep)
        buckets.append((mixed(code[at]) % np.uint64(BUCKETS)).astype(np.int64))
        own = word[at]  # an n-gram from a space on belongs to the word after it
        owner.append(own)
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    inside = owner < len(distinct)
    return buckets[inside], owner[inside]


class Model:
    """Languages, log-probabilities of n-gram buckets and scripts used by each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)) if languages else counts
        self.uses = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1e-9)

    def scores(self, distinct: list[bytes], scripts: np.ndarray) -> np.ndarray:
        """A row for each word; languages that don't use its script are out of question if others do."""
        out = np.empty((len(distinct), len(self.languages)))
        step = max(64, CHUNK // len(self.languages))
        for low in range(0, len(distinct), step):
            part = distinct[low : low + step]
            buckets, owner = _grams(part)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(part)))
            out[low : low + step] = np.add.reduceat(self.logs[buckets[order]], starts, axis=0)
        out -= out.max(axis=1, keepdims=True)
        uses = self.uses[scripts]
        out[~uses & uses.any(axis=1, keepdims=True)] = -1e6
        out[scripts < 0] = 0
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_documents: int = TRAIN_DOCUMENTS) -> Model:
    """Fit a model on about ``train_documents`` documents of each language, chosen by a hash of the id.

    Rows with a null text or language teach nothing.  Without any rows the model knows no language; more
    than ``MOST_LANGUAGES`` are an error, as the model of all languages goes to every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    u = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 20)) / float(1 << 20)
    share: Column = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, train_documents / n)).otherwise(share)
    counted = known.filter(u < share).mapInArrow(_count, "lang string, feature long, n double")
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    counts, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    if found.num_rows:
        column = np.searchsorted(languages, found.column("lang").to_pylist())
        feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
        grams = feature >= 0
        counts[feature[grams], column[grams]] = n[grams]
        scripts[-1 - feature[~grams], column[~grams]] = n[~grams]
    return Model(languages, counts, scripts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for table in grouped(batches, "text", TABLE_BYTES):
        found: dict[str, Counter] = {}
        for lang, texts in zip(table.column("lang").to_pylist(), (x for c in table.column("text").chunks for x in utf8(c))):
            for piece in pieces(texts):
                found.setdefault(lang, Counter()).update(piece.split())
        for lang, counter in found.items():
            grams, scripts = sums.setdefault(lang, (np.zeros(BUCKETS), np.zeros(len(_NAMES))))
            own = [(w, n, s) for w, n in counter.items() if (s := _script(w)) >= 0]
            for low in range(0, len(own), CHUNK):
                part = own[low : low + CHUNK]
                n = np.array([x[1] for x in part], dtype=float)
                buckets, owner = _grams([x[0] for x in part])
                grams += np.bincount(buckets, n[owner], BUCKETS)
                scripts += np.bincount([x[2] for x in part], n, len(_NAMES))
    for lang, (grams, scripts) in sums.items():
        feature = np.concatenate([np.flatnonzero(grams), -1 - np.flatnonzero(scripts)])
        n = np.concatenate([grams[grams > 0], scripts[scripts > 0]])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(feature.astype(np.int64)), pa.array(n)], names=["lang", "feature", "n"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), switch: float = SWITCH) -> DataFrame:
    """Language of every document and of its spans.

    The Viterbi path over the words' scores, paying ``switch`` for a change, labels each word; words
    without letters score alike everywhere.  lang_pred is the language of most words with letters,
    score their share, spans the runs of one language as word ranges (end exclusive).  A text that is
    null or has no letter is ``und`` with score 0 and no spans, as is every text if the model knows no
    language.  Returns id, ``carry`` columns, lang_pred, score, spans, a row for each row of ``docs``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"_c_{c}") for c in carry), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "text"] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    out = chosen.mapInArrow(_label(spark.sparkContext.broadcast(model), switch), schema)
    return out.select(F.col("doc_id").alias(id_col), *(F.col(f"_c_{c}").alias(c) for c in carry), "lang_pred", "score", "spans")


def _label(shared, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(["und", *model.languages], dtype=object)
        limit = TABLE_BYTES * 8 // max(8, len(model.languages))
        for table in grouped(batches, "text", limit):
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            each, counts = [], []
            for text in (x for c in table.column("text").chunks for x in utf8(c)):
                own = [np.fromiter(map(number.__getitem__, w), dtype=np.int32, count=len(w)) for w in map(bytes.split, pieces(text))]
                each += own
                counts.append(sum(map(len, own)))
            ids = np.concatenate([np.zeros(0, dtype=np.int32), *each])
            counts = np.array(counts, dtype=np.int64)
            ends = np.cumsum(counts)
            pred, score = np.full(len(counts), -1), np.zeros(len(counts))
            starts = stops = path_at = np.zeros(0, dtype=np.int64)
            if len(ids) and model.languages:
                distinct = list(number)
                scripts = np.fromiter(map(_script, distinct), dtype=np.int64, count=len(distinct))
                path = viterbi(model.scores(distinct, scripts), ids, counts, switch)
                lettered = (scripts >= 0)[ids]
                doc = np.repeat(np.arange(len(counts)), counts)
                k = len(model.languages)
                votes = np.bincount(doc[lettered] * k + path[lettered], minlength=len(counts) * k).reshape(-1, k)
                sums = votes.sum(axis=1)
                some = sums > 0
                pred[some] = votes[some].argmax(axis=1)
                score[some] = votes[some].max(axis=1) / sums[some]
                change = np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]) & some[doc]
                starts = np.flatnonzero(change)
                path_at = path[starts]
                stops = np.minimum(np.append(starts[1:], len(ids)), ends[doc[starts]])
            owner = np.searchsorted(ends, starts, side="right")
            base = ends[owner] - counts[owner]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
            structs = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(stops - base), pa.array(names[path_at + 1], pa.string())], names=["start", "end", "lang"])
            own = {c: table.column(c) for c in table.column_names if c != "text"}
            own |= {"lang_pred": pa.array(names[pred + 1], pa.string()), "score": pa.array(score), "spans": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)}
            yield from pa.table(own).to_batches()

    return run


def viterbi(scores: np.ndarray, ids: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best state of every word of every sequence; all sequences advance together, longest first.

    scores: a row for each distinct word; ids: the words of the sequences one after another; counts:
    their lengths.  Every switch costs the same, so a state is reached from itself or the best one.
    """
    order = np.argsort(-counts, kind="stable")
    starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    states = scores.shape[1]
    stayed, best_from = np.ones((len(ids), states), dtype=bool), np.zeros(len(ids), dtype=np.int16)
    value = np.zeros((len(lengths), states))
    for t in range(steps):
        m = live[t]
        at = starts[:m] + t
        if t:
            before = value[:m]
            top = before.max(axis=1, keepdims=True) - switch
            stay = before >= top
            stayed[at], best_from[at] = stay, before.argmax(axis=1)
            value[:m] = np.where(stay, before, top) + scores[ids[at]]
        else:
            value[:m] = scores[ids[at]]
    path, state = np.zeros(len(ids), dtype=np.int16), value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at = starts[: live[t]] + t
        own = state[: live[t]]
        path[at] = own
        state[: live[t]] = np.where(stayed[at, own], own, best_from[at])
    return path


def held_out(id_col: str, divisor: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor == rest
