"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.components import components
from tallyloom.llm.text import bounded_batches, grouped, mixed, utf8, word_hashes
from tallyloom.storage import materialise

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**32, three in a million.
BANDS, ROWS = 32, 5
#: Nodes and text bytes on either side of a comparison, about, and shingles in one matrix product.
BLOCK, BLOCK_BYTES = 128, 500_000
MATRIX_COLUMNS = 8192
#: Text bytes signed at once, and elements whose processes run at once.
TABLE_BYTES, SLICE = 1_000_000, 1 << 17


def signatures(docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash registers of weighted sets: rows (doc, element, whole weight), each element once in a doc.

    The weights are cut at 0, 1, 2, 4, 8 ...; over each stretch an element has a Poisson process whose
    rate is the stretch's length, drawn from the element and stretch alone.  A point falls on a place
    of its stretch and on a register, and counts where the place lies below the weight; a register keeps
    its earliest point.  Points come in order of time, so an element is done once its next point is
    later than every register of the document.  Two registers agree with the weighted Jaccard similarity.
    """
    doc, seed, start, length, limit = [], [], [], [], []
    level = 0
    while True:
        low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        own = weights > low
        if not own.any():
            break
        doc.append(docs[own])
        seed.append(mixed(elements[own] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)))
        start.append(np.full(int(own.sum()), low, dtype=float))
        length.append(np.full(int(own.sum()), size, dtype=float))
        limit.append(weights[own].astype(float))
        level += 1
    out = np.full((n_docs, registers), np.inf)
    if doc:
        doc, seed, start, length, limit = (np.concatenate(x) for x in (doc, seed, start, length, limit))
        for low in range(0, len(doc), SLICE):  # a register is the least over slices as it is over elements
            _race(out, *(x[low : low + SLICE] for x in (doc, seed, start, length, limit)))
    return out


def _race(out: np.ndarray, doc: np.ndarray, seed: np.ndarray, start: np.ndarray, length: np.ndarray, limit: np.ndarray) -> None:
    """Lower the registers ``out`` to the earliest points of these elements."""
    registers = out.shape[1]
    time, flat, point = np.zeros(len(doc)), out.reshape(-1), 0
    while len(doc):
        point += 1
        draw = mixed(seed + np.uint64(point * 0xD1B54A32D192ED03 % 2**64))
        time = time - np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / length
        other = mixed(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = ((other >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        place = start + (other & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * length
        falls = np.floor(place) < limit
        np.minimum.at(flat, doc[falls] * registers + register[falls], time[falls])
        if point < 4 or point % 4 == 0:
            live, where = np.unique(doc, return_inverse=True)
            keep = time < out[live].max(axis=1)[where]
            doc, seed, start, length, limit, time = (x[keep] for x in (doc, seed, start, length, limit, time))


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature; the band's number is part of it."""
    bits = registers.view(np.uint64)
    n = bits.shape[1] // rows
    out = np.tile(mixed(np.arange(n, dtype=np.uint64) + np.uint64(77)), (len(bits), 1))
    for k in range(rows):
        out = mixed(out * np.uint64(3) + bits[:, k::rows][:, :n])
    return out.view(np.int64)


def _shingles(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every shingle of texts given by their words' hashes; a text shorter than a shingle is one."""
    counts = np.array([len(w) for w in hashes], dtype=np.int64)
    ids = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(hashes)), counts)
    first = np.arange(len(ids)) - np.repeat(ends - counts, counts)
    starts = np.flatnonzero((first <= counts[doc] - SHINGLE) | (first == 0))
    shingle = np.zeros(len(starts), dtype=np.uint64)
    for k in range(SHINGLE if len(ids) else 0):
        at = starts + k
        inside = at < ends[doc[starts]]
        shingle = mixed(shingle * np.uint64(5) + np.where(inside, ids[np.minimum(at, len(ids) - 1)], np.uint64(k)))
    return doc[starts], shingle


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "text", TABLE_BYTES):
        hashes, digests = [], []
        for text in (x for c in table.column("text").chunks for x in utf8(c)):
            hashes.append(word_hashes(text))
            digests.append(None if text is None else hashlib.blake2b(hashes[-1], digest_size=16).digest())
        some = np.array([len(w) > 0 for w in hashes], dtype=bool)
        doc, shingle = _shingles(hashes)
        del hashes
        key, weight = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (shingle >> np.uint64(24)), return_counts=True)
        del doc, shingle
        registers = signatures((key >> np.uint64(40)).astype(np.int64), mixed(key & np.uint64((1 << 40) - 1)), weight, len(some), BANDS * ROWS)
        buckets = bands(registers)
        offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
        own = {c: table.column(c) for c in table.column_names}
        own |= {"digest": pa.array(digests, pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(buckets[some].reshape(-1)))}
        yield from pa.table(own).to_batches()


def overlaps(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' shingle multisets and of all their intersections, by products of incidence matrices."""
    doc, shingle = _shingles([word_hashes(t) for t in texts])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    sizes = np.bincount(doc, minlength=len(texts))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])[: len(doc)]
    at = np.arange(len(doc))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(doc) else at
    _, feature, held = np.unique(mixed(shingle + mixed(nth.astype(np.uint64))), return_inverse=True, return_counts=True)
    shared = held[feature] > 1
    rank = np.cumsum(held > 1) - 1
    doc, feature = doc[shared], rank[feature[shared]]
    common = np.zeros((len(texts), len(texts)))
    order = np.argsort(feature, kind="stable")
    doc, feature = doc[order], feature[order]
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, MATRIX_COLUMNS):
        a, b = np.searchsorted(feature, [low, low + MATRIX_COLUMNS])
        part = np.zeros((len(texts), MATRIX_COLUMNS), dtype=np.float32)
        part[doc[a:b], feature[a:b] - low] = 1
        common += part @ part.T
    return sizes, common


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        digests, blocks = table.column("digest").to_pylist(), np.array(table.column("block").to_pylist())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sizes, common = overlaps([x for c in table.column("text").chunks for x in utf8(c)])
        close = common >= threshold * (sizes[:, None] + sizes[None, :] - common)
        close &= (blocks == i)[:, None] & (blocks == j)[None, :]
        parent = list(range(len(digests)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for x, y in zip(*np.nonzero(close)):
            if (rx := root(int(x))) != (ry := root(int(y))):
                parent[rx] = ry
                links.append((digests[x], digests[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Class of every document under links of weighted Jaccard similarity ``threshold`` or more.

    Shingles are ``SHINGLE`` consecutive words (lower-cased runs of letters, digits and characters beyond
    ASCII); a shorter text is one shingle.  Equal word sequences are one node.  Nodes that share a band
    are candidates, and buckets that share nodes tie them into clusters.  Inside a cluster all nodes are
    compared, blocks of ``BLOCK`` nodes or ``BLOCK_BYTES`` against each other by a matrix product, and a comparison returns only links that join
    what it had not joined yet; so no link between candidates is lost and no pairs become rows.

    Returns id, ``carry`` columns, class_id (the smallest id of the class) and kept (one row of each class, of
    that id).  A null text is a class of its own; texts without words are equal.  Rows that share an
    id are separate rows.  Of a long text ``PIECE`` bytes are taken apart at a time, so it needs 8 bytes a
    word and no objects.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"_c_{c}") for c in carry if c != text_col), F.col(text_col).alias("text"))
    schema = T.StructType([*chosen.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = materialise(chosen.mapInArrow(_sign, schema), "near-signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    nodes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(first).alias("first"))
    nodes = materialise(nodes, "near-nodes")
    # Merge joins at every size: the right sides grow with the corpus, so none may be broadcast on a small one only.
    rows = nodes.select("digest", F.col("first.row").alias("row"))
    members = _members(signed.join(rows.select("row").hint("merge"), "row", "left_semi").select("digest", F.explode("bands").alias("bucket")))
    clusters = _clusters(members)
    rows = rows.join(clusters, "digest", "left_semi").select("row")
    texts = materialise(signed.select("row", "digest", "text").join(rows.hint("merge"), "row", "left_semi").select("digest", "text", F.octet_length("text").alias("size")), "near-texts")
    labels = _linked(clusters, texts, threshold).withColumnRenamed("node", "_n")
    of = nodes.join(labels, F.col("digest") == F.col("_n"), "left").select("digest", "first", F.coalesce("component", "digest").alias("component"))
    best = of.groupBy("component").agg(F.min("first").alias("best"))
    of = of.join(best, "component").select(F.col("digest").alias("_d"), "best")
    held = [F.col("text" if c == text_col else f"_c_{c}").alias(c) for c in carry]
    out = signed.drop("bands").join(of, F.col("digest") == F.col("_d"), "left")
    best_row = F.coalesce(F.col("best.row"), F.col("row"))
    class_id = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select(F.col("doc_id").alias(id_col), *held, class_id.alias("class_id"), (best_row == F.col("row")).alias("kept"))


def _members(buckets: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one node."""
    many = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return materialise(buckets.join(many.hint("merge"), "bucket"), "near-members")


def _clusters(members: DataFrame) -> DataFrame:
    """digest and cluster of the nodes that buckets tie together."""
    hub = members.groupBy("bucket").agg(F.min("digest").alias("a"))
    tied = members.join(hub, "bucket").select("a", F.col("digest").alias("b"))
    return components(tied, "near-clusters").select(F.col("node").alias("digest"), F.col("component").alias("cluster"))


def _linked(clusters: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Components (node, component) of the verified links inside clusters, block against block."""
    sizes = texts.select("digest", "size").join(clusters, "digest").groupBy("cluster")
    blocks = sizes.agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES, F.lit(1.0))).cast("int").alias("blocks"))
    clusters = materialise(clusters.join(blocks, "cluster").select("digest", "cluster", "blocks"), "near-blocks")
    placed = texts.join(clusters, "digest").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "digest", "block", "text")
    links = tiles.groupBy("cluster", "i", "j").applyInArrow(_compare(threshold), "a binary, b binary")
    return components(materialise(links, "near-links"), "near")
