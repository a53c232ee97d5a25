"""Near-duplicate vectors by an inverted multi-index: product cells, multi-sequence visits to a target recall, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.text import bounded_batches
from tallyloom.storage import materialise

THRESHOLD = 0.9
#: Vectors that the codebooks are fitted on, and that the cost of their number is estimated with, about.
TRAIN_VECTORS, PROBE_VECTORS = 20_000, 500
#: Codewords of each half, at most (or twice the fourth root of the number of vectors, if that is more), and
#: vectors of the sample for each of them.
CODEWORDS, VECTORS_EACH = 48, 40
#: Share of pairs just at the threshold whose cells must meet, and pairs that are drawn for each probe.
RECALL, DRAWN = 0.99, 16
#: Lengths of vectors, most frequent first, that have codebooks of their own; all vectors of another length share a cell.
LENGTHS = 64
#: Vectors on either side of a task's comparison, and queries that are compared at once.
BLOCK, CHUNK = 4096, 256
#: Comparisons that cost as much as sending a vector to a cell.
SHIPPED = 500
#: What rounding may add to a squared distance.
SLACK = 1e-9
#: Rows of a batch that goes out, and vectors times cells that are looked at together.
OUT_ROWS, PLACED = 4096, 1 << 24


class MultiIndex:
    """Two codebooks, one for each half of a vector; a cell is a pair of codewords.

    A vector visits the ``cells`` nearest cells, or, if that is None, all that may hold a link.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, cells: int | None = None):
        self.left, self.right, self.cells = left, right, cells

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squared(units[:, :half], self.left), _squared(units[:, half:], self.right)

    def cell(self, units: np.ndarray) -> np.ndarray:
        a, b = self.distances(units)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def within(self, units: np.ndarray, limit: float) -> np.ndarray:
        """Whether a cell may hold vectors whose squared distance is up to ``limit``, by vector and cell.

        A vector of a cell is on its codeword's side of the bisectors with all other codewords; the
        squared distances from these in both halves add up to no more than the distance from the vector.
        """
        (a, b), out = self.distances(units), np.empty((len(units), len(self.left) * len(self.right)), dtype=bool)
        a, b = _apart(a, self.left), _apart(b, self.right)
        return np.less_equal((a[:, :, None] + b[:, None, :]).reshape(out.shape), limit + SLACK, out=out)

    def visits(self, units: np.ndarray, cells: int) -> np.ndarray:
        """The ``cells`` nearest cells of each vector, nearest first, by multi-sequence traversal of all vectors at once.

        With codewords in order of their distance, cell (i, j) has (i + 1)(j + 1) - 1 others before it that are no
        farther, so only the stairs of pairs below ``cells`` are looked at.
        """
        (a, b), cells = self.distances(units), min(cells, len(self.left) * len(self.right))
        first, second = (np.argsort(x, axis=1, kind="stable")[:, :cells] for x in (a, b))
        i, j = np.array([(i, j) for i in range(first.shape[1]) for j in range(min(second.shape[1], cells // (i + 1)))]).T
        sums = np.take_along_axis(a, first, axis=1)[:, i] + np.take_along_axis(b, second, axis=1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(first[:, i] * len(self.right) + second[:, j], order, axis=1)

    def met(self, units: np.ndarray, limit: float) -> np.ndarray:
        """Whether a vector visits a cell, by vector and cell: of the nearest ``cells`` those that may hold a link."""
        seen = self.within(units, limit)
        if self.cells is not None and self.cells < seen.shape[1]:
            near = np.zeros_like(seen)
            np.put_along_axis(near, self.visits(units, self.cells), True, axis=1)
            seen &= near
        return seen


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def _apart(squared: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Least squared distance from vectors to those nearest to each centre, from the squared distances to the centres."""
    gaps = np.sqrt(np.maximum(_squared(centres, centres), 0))
    bound = np.zeros_like(squared)
    for k in range(len(centres)):  # bisectors with centre k
        far = gaps[k] > 1e-6
        bound[:, far] = np.maximum(bound[:, far], (squared[:, far] - squared[:, k : k + 1]) / (2 * gaps[k, far]))
    return bound * bound


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means, started from k of the vectors."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(10):
        own = _squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each vector that can link, and a digest of them."""
    for batch in batches:
        raw = []
        for x in batch.column("vector").to_pylist():
            usable = x and None not in x
            v = np.array(x if usable else [], dtype=np.float64)
            scale = np.abs(v).max() if len(v) else 0.0
            if usable and np.isfinite(scale) and scale > 0:
                # very large or small components would leave the range of squares; a power of two loses nothing
                raw.append(np.ldexp(v, -int(np.frexp(scale)[1])).tobytes() if not 1e-100 < scale < 1e100 else v.tobytes())
            else:
                raw.append(None)
        keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        names = [c for c in batch.schema.names if c != "vector"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=[*names, "raw", "key"])


def _ranks(index: MultiIndex, units: np.ndarray, threshold: float) -> np.ndarray:
    """Place in a vector's visits of the cells of partners just at the threshold.

    Half of the partners lie in directions that are all alike likely, half towards other vectors of the sample.
    """
    rng = np.random.default_rng(3)
    out = []
    for x in units:
        aside = rng.normal(size=(DRAWN, units.shape[1]))
        aside[::2] = units[rng.integers(0, len(units), len(aside[::2]))]
        aside -= (aside @ x)[:, None] * x
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        partners = threshold * x + np.sqrt(1 - threshold**2) * (aside / np.maximum(length, 1e-12))[length[:, 0] > 1e-9]
        a, b = index.distances(x[None, :])
        sums = (a[0][:, None] + b[0][None, :]).reshape(-1)
        if len(partners):
            out.append(np.searchsorted(np.sort(sums), sums[index.cell(partners)], side="right"))
    return np.concatenate([np.ones(1, dtype=np.int64), *out])


def fit(distinct: DataFrame, n: int, threshold: float = THRESHOLD) -> MultiIndex:
    """Codebooks fitted on about ``TRAIN_VECTORS`` of ``n`` vectors of one length, and the number of cells to visit.

    Of each size of the codebooks the visits are as many as ``RECALL`` of pairs just at the threshold need, drawn at
    random around a sample; links above the threshold are nearer and need fewer.  The size is the one of least cost.
    """
    u = F.pmod(F.xxhash64(F.lit("index"), "key"), F.lit(1 << 20)) / float(1 << 20)
    sample = [bytes(r.raw) for r in distinct.filter(u < min(1.0, TRAIN_VECTORS / n)).select("key", "raw").orderBy("key").collect()]
    if not sample:
        sample = [bytes(distinct.select("raw").first().raw)]
    units = _unit(sample)
    most = max(1, min(max(CODEWORDS, int(np.ceil(2 * n**0.25))), len(units) // VECTORS_EACH))
    half = (units.shape[1] + 1) // 2
    queries = units[:: max(1, -(-len(units) // PROBE_VECTORS))]
    best = None
    for k in sorted({most, *(1 << x for x in range(most.bit_length()))}):
        index = MultiIndex(_codebook(units[:, :half], k, 1), _codebook(units[:, half:], k, 2))
        index.cells = int(np.ceil(np.quantile(_ranks(index, queries, threshold), RECALL)))
        share = np.bincount(index.cell(units), minlength=k * k) / len(units)
        seen = index.met(queries, 2 - 2 * threshold) & (np.arange(k * k) >= index.cell(queries)[:, None])
        met = n * (seen @ share).mean()
        cost = seen.sum(axis=1).mean() + 2 * met / BLOCK + met / SHIPPED
        if best is None or cost < best[0]:
            best = cost, index
    return best[1]


def _place(shared, threshold: float):
    """Each vector in its cell (side 0), and in the cells from its own on that it visits (side 1).

    shared: the index and the number of the first cell of each length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for whole in batches:
            lengths = np.array([len(r) for r in whole.column("raw").to_pylist()], dtype=np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                index, base = indexes[int(length)]
                size = max(1, PLACED // (len(index.left) * len(index.right)))
                for low in range(0, len(mine), size):
                    batch = whole.take(pa.array(mine[low : low + size]))
                    x = _unit(batch.column("raw").to_pylist())
                    own, seen = index.cell(x), index.met(x, 2 - 2 * threshold)
                    # a link between two cells is met by the vector of the first one
                    row, cell = np.nonzero((seen & (np.arange(seen.shape[1]) > own[:, None])) | (np.arange(seen.shape[1]) == own[:, None]))
                    rows, cells = np.concatenate([np.arange(len(x)), row]), base + np.concatenate([own, cell])
                    side = np.repeat(np.array([0, 1], dtype=np.int32), [len(x), len(row)])
                    for at in range(0, len(rows), OUT_ROWS):
                        part = slice(at, at + OUT_ROWS)
                        taken = batch.take(pa.array(rows[part]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(base + own[rows[part]]), pa.array(cells[part]), pa.array(side[part])], names=[*taken.schema.names, "own", "cell", "side"])

    return run


def _compare(threshold: float):
    """Links between the members of a cell and those who visit it: a count for each vector, and edges that join."""

    def run(table: pa.Table) -> pa.Table:
        side, keys = np.array(table.column("side").to_pylist()), table.column("key").to_pylist()
        members, queries = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = {k: n for n, k in enumerate(dict.fromkeys(keys))}
        node, edges = np.array([place[k] for k in keys], dtype=np.int64), []
        sums, group = np.zeros(len(place), dtype=np.int64), np.arange(len(place))
        if len(members) and len(queries):
            x, times = _unit(table.column("raw").to_pylist()), np.array(table.column("times").to_pylist(), dtype=np.int64)
            elsewhere = np.array(table.column("own").to_pylist()) != table.column("cell")[0].as_py()
            for at in range(0, len(queries), CHUNK):
                part = queries[at : at + CHUNK]
                close = (x[part] @ x[members].T >= threshold) & (node[part][:, None] != node[members][None, :])
                for r in np.flatnonzero(close.any(axis=1)):
                    q, hit = part[r], members[close[r]]
                    sums[node[q]] += times[hit].sum()
                    if elsewhere[q]:  # the members never meet the visitor themselves
                        np.add.at(sums, node[hit], times[q])
                    others, first = np.unique(group[node[hit]], return_index=True)
                    new = others != group[node[q]]
                    if new.any():
                        edges += [(keys[q], keys[m]) for m in hit[first[new]]]
                        group[np.isin(group, others[new])] = group[node[q]]
        names = list(place)
        counted = np.flatnonzero(sums)
        a = [*(names[n] for n in counted), *(e[0] for e in edges)]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array([None] * len(counted) + [e[1] for e in edges], pa.binary()), "n": pa.array([*sums[counted].tolist(), *([0] * len(edges))], pa.int64())})

    return run


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, index: MultiIndex | None = None) -> DataFrame:
    """Links of cosine ``threshold`` or more between all vectors, and their components.

    Equal vectors are one entry with a number of copies.  An entry stands in the cell of its nearest
    codewords and visits cells, from its own on, nearest first: as many as ``RECALL`` of pairs just at the
    threshold need (see ``fit``), without those that the bisectors between codewords put beyond the threshold's distance.
    It is compared with all that stand there, block against block in double precision, so nothing below the threshold
    links.  An ``index`` whose cells is None loses no link at all.  Vectors of different lengths do not meet; each
    length has an index of its own.

    Returns id, n_links (other rows linked directly), component_id (smallest id reachable) and kept (id =
    component_id).  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  Rows that share an id are rows of their own.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = chosen.schema["id"].dataType.simpleString()
    packed = materialise(chosen.mapInArrow(_pack, f"id {kind}, raw binary, key binary"), "vec-packed")
    usable = packed.filter("raw IS NOT NULL")
    distinct = materialise(usable.groupBy("key").agg(F.first("raw").alias("raw"), F.min("id").alias("least"), F.count("*").alias("times")), "vec-distinct")
    lengths = distinct.groupBy(F.octet_length("raw").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").collect()  # a row for each length
    if not lengths:
        alone = F.lit(0).cast("long")
        return packed.select(F.col("id").alias(id_col), alone.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    indexes, base = {}, 0
    for k, (length, n) in enumerate(lengths):
        own = distinct.filter(F.octet_length("raw") == length)
        given = index if index is not None and 8 * (index.left.shape[1] + index.right.shape[1]) == length else None
        one = MultiIndex(np.zeros((1, (length // 8 + 1) // 2)), np.zeros((1, length // 8 // 2)))
        indexes[length] = given or (fit(own, n, threshold) if k < LENGTHS else one), base
        base += len(indexes[length][0].left) * len(indexes[length][0].right)
    placed = distinct.select("key", "raw", "times").mapInArrow(_place(spark.sparkContext.broadcast(indexes), threshold), "key binary, raw binary, times long, own long, cell long, side int")
    placed = materialise(placed, "vec-placed")
    many = placed.groupBy("cell").agg(*(F.ceil(F.count_if(F.col("side") == s) / BLOCK).cast("int").alias(f"blocks{s}") for s in (0, 1)))
    # a row for each cell, of which there are no more than the codebooks make: no cell's vectors meet in one task for it
    tiles = placed.join(F.broadcast(many.filter("blocks0 > 0")), "cell")
    mine, other = (F.when(F.col("side") == s, F.col("blocks0")).otherwise(F.col("blocks1")) for s in (0, 1))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("key"), mine).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), other - 1)))
    tiles = tiles.withColumns({"i": F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("o")), "j": F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("block"))})
    met = tiles.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "a binary, b binary, n long")
    met = materialise(met, "vec-links")
    counts = met.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    found = components(met.filter("b IS NOT NULL").select("a", "b"), "vec")
    of = distinct.join(counts.withColumnRenamed("a", "key"), "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left")
    of = of.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    best = of.groupBy("component").agg(F.min("least").alias("best"))
    of = of.join(best, "component").select("key", "n_links", "best")
    out = packed.select("id", F.when(F.col("raw").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("best"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
