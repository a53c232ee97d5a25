"""Removal of long repeated byte strings by blockwise difference-cover suffix sorting.

Whether two long strings are equal is settled inside buckets.  Of the k-grams in a window the smallest by
hash is its anchor, so equal windows have equal anchors at the same distance; windows that follow one
another with one anchor form a region.  A region that occurs twice as a whole is repeated; an anchor
whose k-gram is unique repeats nothing.  What is left, regions that share an anchor but not everything,
is sorted: a block of buckets at a time, suffixes that tie on ``COVER`` bytes by the ranks of a difference
cover's sample, so memory follows the block and not the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import bounded_batches, grouped, mixed, utf8
from tallyloom.storage import materialise

#: Bytes of a string whose repetition counts, and of one that is reported only: some fifty words.
LENGTH, SHORT = 400, 288
#: Bytes of an anchor.
GRAM = 64
#: Period of the difference cover.
COVER = 32
#: Text bytes handled at once, and bytes of a piece of a long text.
GROUP_BYTES, PIECE_BYTES = 2_000_000, 1_000_000
#: Bytes of the regions that are sorted together.
BLOCK_BYTES = 1_000_000
#: A bucket of more regions is split by where windows start, in steps so wide.
HOT = 512
WIDTHS = (32, 4, 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any substrings of a byte array, by prefix sums of powers modulo 2**64."""

    _powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers[0]) <= n:
            bases = [np.full(n + 1, b % 2**64, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
            for b in bases:
                b[0] = 1
            Rolling._powers = tuple(np.cumprod(b) for b in bases)
        up, self.down = Rolling._powers
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    after = np.minimum.accumulate(rows, axis=1).reshape(-1)
    before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def regions(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM, behind: int = 0):
    """Piece, first and last window start, anchor, hashes of anchor and region, and bytes behind of every region.

    A region's bytes go to the end of its last window and up to ``behind`` bytes farther, as far as its piece goes.
    Windows start in the first ``PIECE_BYTES`` of a piece.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none, none, none
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    grams = rolling.of(at, at + gram)
    packed = (grams & np.uint64(2**64 - 2**22)) | at.astype(np.uint64)
    anchors = (_window_minima(packed, length - gram + 1) & np.uint64(2**22 - 1)).astype(np.int64)
    starts = np.arange(len(anchors))
    piece = np.searchsorted(ends, starts, side="right")
    inside = (starts + length <= ends[piece]) & (starts - (ends - sizes)[piece] < PIECE_BYTES)
    starts, anchors, piece = starts[inside], anchors[inside], piece[inside]
    if not len(starts):
        return none, none, none, none, none, none, none
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (piece[1:] != piece[:-1])])
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    anchor, piece = anchors[new], piece[new]
    more = np.minimum(ends[piece] - last - length, behind)
    shape = ((anchor - first) * 4096 + (last - first)) * 4096 + more
    region = rolling.of(first, last + length + more) ^ mixed(shape.astype(np.uint64))
    base = (ends - sizes)[piece]
    return piece, first - base, last - base, anchor - base, grams[anchor].view(np.int64), region.view(np.int64), more


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "text", GROUP_BYTES):
        ids, hashes = table.column("id").to_pylist(), table.column("h").to_pylist()
        pieces, owner, offset = [], [], []

        def flush():
            piece, first, last, anchor, gram, region, more = regions(pieces, SHORT, behind=LENGTH - SHORT)
            own, base = np.array(owner, dtype=np.int64)[piece], np.array(offset, dtype=np.int64)[piece]
            pieces.clear(), owner.clear(), offset.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in own], pa.string()), pa.array([hashes[k] for k in own], pa.int64()), *(pa.array(x) for x in (first + base, last + base, anchor + base, gram, region, more))],
                names=["id", "h", "first", "last", "anchor", "gram", "region", "more"],
            )

        held = 0
        for k, text in enumerate(x for c in table.column("text").chunks for x in utf8(c)):
            for low in range(0, max(0, len(text) - SHORT + 1), PIECE_BYTES):
                pieces.append(text[low : low + PIECE_BYTES + LENGTH - 1])
                owner.append(k)
                offset.append(low)
                held += len(pieces[-1])
                if held >= GROUP_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions asked for."""
    for table in grouped(batches, "text", GROUP_BYTES):
        out = {c: [] for c in ("id", "h", "first", "last", "anchor", "key", "data")}
        texts = [x for c in table.column("text").chunks for x in utf8(c)]
        for key, h, text, wanted in zip(table.column("id").to_pylist(), table.column("h").to_pylist(), texts, table.column("wanted").to_pylist()):
            for w in wanted:
                for c, v in zip(out, (key, h, w["first"], w["last"], w["anchor"], w["gram"], text[w["first"] : w["last"] + LENGTH])):
                    out[c].append(v)
        types = {"id": pa.string(), "data": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], names=list(out))


def _split(width: int, length: int):
    """Pieces of regions by ``width`` distances from the anchor, keyed by the bytes that all windows there hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in batch.schema.names}
            for row in batch.to_pylist():
                first, last, anchor = row["first"], row["last"], row["anchor"]
                for j in range((anchor - last) // width, (anchor - first) // width + 1):
                    low, high = max(first, anchor - (j + 1) * width + 1), min(last, anchor - j * width)
                    core = row["data"][anchor - j * width - first : anchor - (j + 1) * width + 1 + length - first]
                    mark = hashlib.blake2b(core, digest_size=8, key=row["key"].to_bytes(8, "little", signed=True) + bytes([j % 256, j // 256, width])).digest()
                    new = row | {"first": low, "last": high, "key": int.from_bytes(mark, "little", signed=True), "data": row["data"][low - first : high + length - first]}
                    for c, v in new.items():
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field(c).type) for c, v in out.items()], names=list(out))

    return run


def _cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover and, for two residues, the least shift that takes both into it."""
    step = int(np.ceil(np.sqrt(period)))
    inside = np.zeros(period, dtype=bool)
    inside[:step] = True  # any difference is a multiple of step less one of these
    inside[np.arange(0, period + step, step) % period] = True
    residues = np.arange(period)
    shift = np.zeros((period, period), dtype=np.int64)
    for d in range(period - 1, -1, -1):
        both = inside[(residues[:, None] + d) % period] & inside[(residues[None, :] + d) % period]
        shift[both] = d
    return inside, shift


_IN_COVER, _SHIFT = _cover(COVER)


def _named(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the columns and the number of each row's value in that order."""
    order = np.lexsort(columns[::-1])
    differs = np.zeros(len(order), dtype=bool)
    for c in columns:
        o = c[order]
        differs[1:] |= o[1:] != o[:-1]
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(differs)
    return order, names


def sample_ranks(data: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by ``depth`` bytes at least, of the suffixes that start in the cover; 0 past the end."""
    n = len(data)
    at = np.flatnonzero(_IN_COVER[np.arange(n) % COVER])
    names = _named([words[at + 8 * k] for k in range(COVER // 8)])[1]
    ranks, width = np.zeros(n + 2 * max(depth, COVER), dtype=np.int64), COVER
    while True:
        ranks[at] = names + 1
        if width >= depth or (len(names) and names.max() == len(names) - 1):
            return ranks
        names = _named([ranks[at], ranks[np.minimum(at + width, len(ranks) - 1)]])[1]
        width *= 2


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """``starts`` in the order of their suffixes, by ``depth`` bytes at least.

    One bucket of suffixes that agree on ``COVER`` bytes after another; within a bucket two suffixes
    are told apart by the ranks of the sample at the shift that takes both into the cover.
    """
    padded = np.concatenate([data, np.zeros(COVER + 16, dtype=np.uint8)])
    words = np.zeros(len(data) + COVER, dtype=np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    ranks = sample_ranks(data, words, depth)
    order, bucket = _named([words[starts + 8 * k] for k in range(COVER // 8)])
    out, group = starts[order], bucket[order]
    open_ = np.arange(len(out))
    while True:
        own = group[open_]
        head = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=bool)
        size = np.diff(np.append(np.flatnonzero(head), len(own)))
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            return out
        size = size[size > 1]
        begin = np.cumsum(size) - size
        pivot = np.repeat(out[open_[begin + size // 2]], size)
        x = out[open_]
        shift = _SHIFT[x % COVER, pivot % COVER]
        side = np.sign(ranks[x + shift] - ranks[pivot + shift])
        number = np.repeat(np.arange(len(size)), size)
        again = np.lexsort((side, number))
        out[open_], side = x[again], side[again]
        cell = number * 3 + side + 1
        group = np.zeros(len(out), dtype=np.int64)
        group[open_] = cell
        open_ = open_[side != 0]


def _repeats(length: int = LENGTH, short: int = SHORT):
    """Byte ranges covered by windows that occur more than once among the regions of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= BLOCK_BYTES and row["key"] != last:
                    yield _block(held, length, short)
                    held, size = [], 0
                held.append(row)
                size += len(row["data"])
                last = row["key"]
        if held:
            yield _block(held, length, short)

    return run


def _windows(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, where each row begins, and the starts of all windows."""
    sizes = np.array([len(r["data"]) for r in rows], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    windows = np.array([r["last"] - r["first"] + 1 for r in rows], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), windows)
    starts = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return np.frombuffer(b"".join(r["data"] for r in rows), dtype=np.uint8), base, starts


def _runs(order: np.ndarray, hashes: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of runs of sorted windows that are equal to a neighbour."""
    equal = hashes[1:] == hashes[:-1]
    twice = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    found = np.sort(order[twice[: len(order)]])
    own = np.searchsorted(base, found, side="right") - 1
    new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (own[1:] != own[:-1])])[: len(found)]
    begin = found[new]
    end = found[np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)] if len(found) else begin
    return own[new], begin, end


def _block(rows: list[dict], length: int = LENGTH, short: int = SHORT) -> pa.RecordBatch:
    # a row none of whose windows has an equal by its hash repeats nothing and need not be sorted
    data, base, starts = _windows(rows)
    hashes = Rolling(data).of(starts, starts + short)
    _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
    live = np.unique(np.searchsorted(base, starts[times[group] > 1], side="right") - 1)
    rows = [rows[k] for k in live]
    data, base, starts = _windows(rows)
    ends = np.append(base[1:], len(data))
    order = sorted_suffixes(data, starts, length)
    rolling = Rolling(data)
    owner = np.searchsorted(base, order, side="right") - 1
    long = order[order + length <= ends[owner]] if len(order) else order
    own, begin, end = _runs(order, rolling.of(order, order + short), base)
    own_long, begin_long, end_long = _runs(long, rolling.of(long, long + length), base)
    shift = np.array([r["first"] for r in rows], dtype=np.int64) - base
    own, begin = np.concatenate([own, own_long]), np.concatenate([begin + shift[own], begin_long + shift[own_long]])
    end = np.concatenate([end + shift[own[: len(end)]] + short, begin[len(end) :]])
    long_end = np.concatenate([begin[: len(begin) - len(own_long)], end_long + shift[own_long] + length])
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[k]["id"] for k in own], pa.string()), pa.array([rows[k]["h"] for k in own], pa.int64()), pa.array(begin), pa.array(end), pa.array(long_end)],
        names=["id", "h", "start", "end", "long_end"],
    )


def repeated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Byte ranges (id, h, start, end, long_end) covered by strings that start more than once.

    From start to end ``SHORT``-byte strings cover every byte, from start to long_end such of ``LENGTH``; a range may be
    empty.  docs: id (string), h (a hash of the text) and the text.
    """
    spark = docs.sparkSession
    anchors = docs.filter(F.octet_length(text_col) >= SHORT).select("id", "h", F.col(text_col).alias("text"))
    anchors = materialise(anchors.mapInArrow(_anchors, "id string, h long, first long, last long, anchor long, gram long, region long, more long"), "suffix-anchors")
    one = F.struct("id", "h", "first", "last", "anchor")
    groups = anchors.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    groups = materialise(groups, "suffix-regions")
    stop = F.col("last") + SHORT + F.col("more")
    whole = anchors.join(groups.filter("n > 1").select("gram", "region"), ["gram", "region"]).select(
        "id", "h", F.col("first").alias("start"), (F.col("last") + SHORT).alias("end"), F.when(stop - F.col("first") >= LENGTH, stop).otherwise(F.col("first")).alias("long_end")
    )
    partly = groups.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 AND least = 1").select("gram")
    wanted = groups.join(partly, "gram").select("one.id", "one.h", F.struct("one.first", "one.last", "one.anchor", "gram").alias("w"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select("id", "h", F.col(text_col).alias("text")).join(wanted, ["id", "h"])
    schema = "id string, h long, first long, last long, anchor long, key long, data binary"
    # rows alike in id and text give the same excerpts, which count once: a whole region that occurs twice is found above
    open_ = materialise(texts.mapInArrow(_excerpts, schema).dropDuplicates(["id", "h", "first"]), "suffix-excerpts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(open_.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1"), "suffix-sizes")  # written, so that hot keys' rows can be split
    placed = open_.join(sizes, "key").select(*open_.columns, "_n")
    small = placed.filter(F.col("_n") <= HOT).drop("_n").repartition(parts, "key").sortWithinPartitions("key")
    ranges = "id string, h long, start long, end long, long_end long"
    found = [whole, materialise(small.mapInArrow(_repeats(), ranges), "suffix-found")]
    hot = materialise(placed.filter(F.col("_n") > HOT).drop("_n"), "suffix-hot")
    if not hot.isEmpty():
        start, nothing = F.col("start"), F.col("start").alias
        short = hot.withColumn("data", F.expr(f"substring(data, 1, cast(last - first + {SHORT} as int))"))
        long = hot.withColumn("last", F.col("first") + F.octet_length("data") - LENGTH).filter("last >= first")
        found += [f.select("id", "h", start, "end", nothing("long_end")) for f in _hot(short, SHORT, parts)]
        found += [f.select("id", "h", start, nothing("end"), F.col("end").alias("long_end")) for f in _hot(long, LENGTH, parts)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _hot(open_: DataFrame, length: int, parts: int) -> list[DataFrame]:
    """Byte ranges (id, h, start, end) covered by repeated windows of one length in buckets of many regions.

    Of equal regions one goes on and all are repeated; buckets are then split by where windows start.  A long
    passage in many texts so soon is one region, and what stands around it differs and falls apart.
    """
    found, schema = [], "id string, h long, first long, last long, anchor long, key long, data binary"
    for width in (*WIDTHS, 0):
        marked = materialise(open_.withColumn("_d", F.md5("data")), f"suffix-marked-{length}-{width}")
        row = F.struct("id", "h", "first", "last", "anchor", "data")
        equal = materialise(marked.groupBy("key", "_d").agg(F.count("*").alias("_m"), F.min(row).alias("_one")), f"suffix-equal-{length}-{width}")
        many = marked.join(equal.filter("_m > 1").select("key", "_d"), ["key", "_d"])
        found.append(many.select("id", "h", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
        if not width:  # windows of one key are equal
            break
        open_ = equal.select("_one.id", "_one.h", "_one.first", "_one.last", "_one.anchor", "key", "_one.data")
        sizes = materialise(open_.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1"), f"suffix-sizes-{length}-{width}")
        placed = open_.join(sizes, "key")
        small = placed.filter(F.col("_n") <= HOT).select(*open_.columns).repartition(parts, "key").sortWithinPartitions("key")
        sorted_ = materialise(small.mapInArrow(_repeats(length, length), "id string, h long, start long, end long, long_end long"), f"suffix-found-{length}-{width}")
        found.append(sorted_.filter("end > start").select("id", "h", "start", "end"))
        open_ = materialise(placed.filter(F.col("_n") > HOT).select(*open_.columns).mapInArrow(_split(width, length), schema), f"suffix-split-{length}-{width}")
        if open_.isEmpty():
            break
    return found


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(x for x in spans if x[0] < x[1]):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, repeats, kept = [], [], []
        for text, own in zip(utf8(batch.column("text")), batch.column("found").to_pylist()):
            text, at, rest = text or b"", 0, []
            spans.append(_merged([(x["start"], x["long_end"]) for x in own or []]))
            repeats.append(_merged([(x["start"], x[e]) for x in own or [] for e in ("end", "long_end")]))
            for s in spans[-1]:
                rest.append(text[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*rest, text[at:]]))
        names = [c for c in batch.schema.names if c not in ("text", "found")]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(spans, span), pa.array(repeats, span), pa.array(kept, pa.binary())], names=[*names, "removed", "repeated", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every text without the bytes covered by a ``LENGTH``-byte string that also starts elsewhere.

    Texts are UTF-8 bytes and strings never cross texts; every copy goes, overlaps count, and strings
    are judged on the input.  Returns id, ``carry`` columns, n_bytes, removed (the maximal byte ranges), repeated (those
    covered by ``SHORT``-byte strings that also start elsewhere, which stay unless they are removed) and
    kept (the bytes left, which may cut a character).  Null and empty texts have no bytes, shorter ones
    lose none; each row of a repeated id counts as a text of its own.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"_c_{c}") for c in carry), text.alias("text"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("h"),
    )
    found = repeated(keyed).distinct().groupBy("id", "h").agg(F.collect_list(F.struct("start", "end", "long_end")).alias("found"))
    joined = keyed.join(found, ["id", "h"], "left").select("doc_id", *(f"_c_{c}" for c in carry), "text", "found", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("text", "found")]
    out = joined.mapInArrow(_removed, ", ".join([*fields, "removed array<struct<start:bigint,end:bigint>>", "repeated array<struct<start:bigint,end:bigint>>", "kept binary"]))
    return out.select(F.col("doc_id").alias(id_col), *(F.col(f"_c_{c}").alias(c) for c in carry), "n_bytes", "removed", "repeated", "kept")
