"""Byte-level helpers that the operators' Arrow functions share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Lower-cases A-Z and turns every ASCII byte other than a letter or digit into a space.  Bytes of
#: 0x80 and above belong to words, so words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: Records in one Arrow batch, so that a batch of long texts stays small.
BATCH_RECORDS = 512
#: Bytes of a text whose words are hashed at once.
PIECE = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_RECORDS`` records at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_RECORDS:
        spark.conf.set(key, str(BATCH_RECORDS))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def pieces(text: bytes | None, table: bytes = WORD_BYTES) -> Iterator[bytes]:
    """A text by ``table``, in pieces of ``PIECE`` bytes that end at a space."""
    low, data = 0, text.translate(table) if text else b""
    while low < len(data):
        high = data.find(b" ", low + PIECE)
        high = len(data) if high < 0 else high
        yield data[low:high]
        low = high


def word_hashes(text: bytes | None, table: bytes = WORD_BYTES) -> np.ndarray:
    """64-bit hashes of a text's words by ``table`` in order; numbers only, ``PIECE`` bytes at a time."""
    found = [_hashed(np.frombuffer(piece, dtype=np.uint8)) for piece in pieces(text, table)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _hashed(data: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], data != 32, [False]])))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTES[data[data != 32]] * powers[place], first) + sizes.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def grouped(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Successive batches joined to tables of about ``limit`` bytes of texts or numbers; a longer batch is cut by rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            lengths = _lengths(batch.column(text).slice(at))
            take = int(np.searchsorted(np.cumsum(lengths), max(1, limit - size))) + 1
            part = batch.slice(at, take)
            held.append(part)
            size += int(lengths[:take].sum())
            at += take
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    if pa.types.is_list(column.type):
        return np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64) * column.type.value_type.bit_width // 8
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
