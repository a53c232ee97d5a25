"""Benchmark decontamination with an FM-index for each shard of training documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.text import bounded_batches, grouped, utf8, words
from tallyloom.storage import materialise

#: Text bytes of a shard, for which one index is built.
SHARD_BYTES = 8_000_000
#: Benchmark bytes, about, that are made to windows on the driver and sent to the executors at once; a larger
#: benchmark goes in blocks, a pass each.
BLOCK_BYTES = 2_000_000
#: Every so many positions of the indexed text keep their place.
SAMPLE = 16

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletMatrix:
    """Ranks of integer symbols in a sequence, a bit plane for each binary digit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.planes: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            self.planes.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position ``at``."""
        start, at = np.zeros_like(at), at.copy()
        for bit, before, zeros in self.planes:
            one = ((symbol >> bit) & 1).astype(bool)
            ones_at, ones_start = before[at], before[start]
            at = np.where(one, zeros + ones_at, at - ones_at)
            start = np.where(one, zeros + ones_start, start - ones_start)
        return at - start


class FMIndex:
    """Backward search and location over runs of word codes; code 0 parts the runs and never matches."""

    def __init__(self, codes: np.ndarray, top: int):
        n = len(codes)
        order = _suffix_array(codes)
        self.bwt = codes[order - 1]
        self.ranks = WaveletMatrix(self.bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top + 1))])
        starts = np.zeros(n, dtype=bool)
        starts[0], starts[1:] = True, codes[:-1] == 0
        kept = starts | (np.arange(n) % SAMPLE == 0)  # a walk never has to cross a border
        self.place = np.where(kept[order], order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern numbers that occur, with their ranges of the suffix array."""
        at = np.arange(len(patterns))
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(self.bwt), dtype=np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[at, column]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
            found = low < high
            at, low, high = at[found], low[found], high[found]
        return at, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-array rows, by walking to the next kept position."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            place = self.place[rows[open_]]
            done = place >= 0
            out[open_[done]] = place[done] + steps[open_[done]]
            open_ = open_[~done]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.first[symbol] + self.ranks.rank(symbol, rows[open_])
            steps[open_] += 1
        return out


def _suffix_array(codes: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 counts as a symbol of its own, in order of position."""
    n, zero = len(codes), codes == 0
    rank = np.where(zero, np.cumsum(zero) - 1, codes.astype(np.int64) + int(zero.sum()))
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2


class Phrases:
    """The windows of a block of benchmark items, as word codes."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[k : k + window]), set()).add(item)
        self.vocabulary, self.top = vocabulary, len(vocabulary)
        self.lengths: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == n]
            self.lengths[n] = np.array(own, dtype=np.int64), [sorted(owners[w]) for w in own]
        pairs = {a * (self.top + 1) + b for w in owners for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  A window is
    ``window`` consecutive words of an item; a shorter item is one window, an item without words
    none.  A shard of documents keeps the stretches in which every two neighbours also stand side by
    side in some window (no window fits elsewhere), indexes them, searches all windows backward
    through wavelet ranks, and locates them by kept positions.

    Returns id, n_words, n_hit, spans (merged word ranges, end exclusive), items (distinct ids as
    strings, sorted), ``carry`` columns and, with ``keep_text``, kept_text: the text without the
    bytes from the first to the last word of each span.  Null and empty texts have no words; rows with
    the same id are separate rows; items with the same id are one; a null item id is the empty string.
    An empty benchmark hits nothing.  Columns of the two tables may share names.

    A benchmark beyond ``BLOCK_BYTES`` goes in blocks of items by hash.  Each is a pass over the texts, which are
    written once, and leaves a table of the documents it hits; neither the driver nor a task holds more than a block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    state = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"), *(F.col(c).alias(f"_c_{c}") for c in carry),
    )
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1

    def scanned(df: DataFrame, k: int) -> DataFrame:
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        phrases = Phrases([(r.item, r.text.encode() if r.text is not None else None) for r in part.collect()], window)
        return df.mapInArrow(_scan(spark.sparkContext.broadcast(phrases)), df.schema)

    if blocks == 1:
        state = scanned(state, 0)
    else:
        state = materialise(state.withColumn("row", F.monotonically_increasing_id()), "decontaminate-texts")
        texts = state.select("row", "text", "n_words", "spans", "items")
        passes = [materialise(scanned(texts, k).filter(F.lit(k == 0) | (F.size("spans") > 0)).drop("text"), f"decontaminate-{k}") for k in range(blocks)]
        found = reduce(DataFrame.union, passes).groupBy("row").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        state = state.drop("n_words", "spans", "items").join(found.withColumn("spans", _merged_spans(F.col("spans"))), "row")
    if keep_text:
        kept = F.pandas_udf(_cut, T.StringType())("text", "spans")
        state = state.withColumn("kept_text", F.when(F.size("spans") > 0, kept).otherwise(F.col("text")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return state.select(
        F.col("doc_id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items", *(F.col(f"_c_{c}").alias(c) for c in carry), *(["kept_text"] if keep_text else [])
    )


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for table in grouped(batches, "text", SHARD_BYTES):
            texts = [x for c in table.column("text").chunks for x in utf8(c)]
            split = [words(t) for t in texts]
            counts = np.array([len(w) for w in split], dtype=np.int64)
            docs, starts, lengths, ids = _hits(phrases, split, counts)
            spans, items = table.column("spans").to_pylist(), table.column("items").to_pylist()
            order = np.argsort(docs, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1) if len(order) else []:
                d = docs[own[0]]
                old = [(s["start"], s["end"]) for s in spans[d]]
                spans[d] = _merged([*old, *zip(starts[own].tolist(), (starts[own] + lengths[own]).tolist())])
                items[d] = sorted({*items[d], *chain.from_iterable(ids[k] for k in own)})
            names = table.column_names
            columns = {c: table.column(c) for c in names}
            columns |= {"n_words": pa.array(counts), "spans": pa.array(spans, type=table.schema.field("spans").type), "items": pa.array(items, type=table.schema.field("items").type)}
            yield from pa.table([columns[c] for c in names], names=names).to_batches()

    return run


def _hits(phrases: Phrases, split: list[list[bytes]], counts: np.ndarray):
    """Document, first word, length and item ids of every occurrence of a window in a shard."""
    none = np.zeros(0, dtype=np.int64)
    total = int(counts.sum())
    if not total or not phrases.lengths:
        return none, none, none, []
    codes = np.fromiter(map(phrases.vocabulary.get, chain.from_iterable(split), repeat(0)), dtype=np.int64, count=total)
    ends = np.cumsum(counts)
    joined = (codes[:-1] > 0) & (codes[1:] > 0)
    joined[ends[(ends > 0) & (ends < total)] - 1] = False
    at = np.flatnonzero(joined)
    key = codes[at] * (phrases.top + 1) + codes[at + 1]
    where = np.searchsorted(phrases.pairs, key)
    known = np.zeros(len(at), dtype=bool)
    inside = where < len(phrases.pairs)
    known[inside] = phrases.pairs[where[inside]] == key[inside]
    joined[at[~known]] = False
    # runs of word positions whose neighbours are joined
    first = np.flatnonzero((codes > 0) & np.concatenate([[True], ~joined]))
    last = np.flatnonzero((codes > 0) & np.concatenate([~joined, [True]]))
    long = last - first + 1 >= min(phrases.lengths)
    first, last = first[long], last[long]
    if not len(first):
        return none, none, none, []
    sizes = last - first + 1
    heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(heads, sizes) + inner] = codes[np.repeat(first, sizes) + inner]
    index = FMIndex(text, phrases.top)
    docs, starts, lengths, ids = [], [], [], []
    for n, (patterns, owners) in phrases.lengths.items():
        found, low, high = index.search(patterns)
        many = high - low
        rows = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = index.locate(rows)
        run = np.searchsorted(heads, place, side="right") - 1
        word = first[run] + place - heads[run]
        doc = np.searchsorted(ends, word, side="right")
        docs.append(doc)
        starts.append(word - (ends[doc] - counts[doc]))
        lengths.append(np.full(len(word), n))
        ids += [owners[p] for p in np.repeat(found, many)]
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(lengths), ids


def _merged_spans(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), step)


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _cut(texts, spans):
    import pandas as pd

    out = []
    for text, own in zip(texts, spans):
        if text is None or not len(own):
            out.append(text)
            continue
        at, parts, places = 0, [], [m.span() for m in _WORD.finditer(text)]
        for s in own:
            parts.append(text[at : places[s["start"]][0]])
            at = places[s["end"] - 1][1]
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)
