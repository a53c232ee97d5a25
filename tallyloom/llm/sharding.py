"""Minimax contiguous partition: shards of near equal bytes that never split a group of equal texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.ordered import positioned
from tallyloom.storage import materialise

#: Boundaries looked at in one pass, for each shard.
GRID = 2048


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near equal bytes.

    Equal texts form an atomic group; groups stand in the order of their SHA-256.  The smallest
    feasible capacity is found by binary search with a greedy check, and the cuts are then placed as
    near to even as that capacity allows.  Group sizes stay distributed: the driver sees at most
    ``GRID`` boundaries a shard in each pass and narrows the places where a cut can fall until they
    are exact.

    Returns id, size (UTF-8 bytes + 1), text_crc32, law ``bytes``, shard, slot (gapless from 0 in a
    shard) and grown_shard (null under this law).  Null texts have size 1 and CRC 0 and are each a
    group of their own; empty texts are equal texts.  Rows with the same id are separate rows; rows
    equal in id and text are interchangeable.  An empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    alone = F.concat(F.lit("null "), F.coalesce(F.col(id_col).cast("string"), F.lit("-")))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), alone).cast("binary"), 256)).alias("_key"),
    )
    sized = materialise(sized, "shard-sizes")
    placed = positioned(sized, [F.col("_key"), F.col("doc_id")], "size", "shard-rows")
    groups = materialise(
        placed.groupBy("_key").agg(F.max("upto").alias("end"), (F.max("pos") + 1).alias("rows"), F.sum("size").alias("bytes")),
        "shard-groups",
    )
    cuts = _cuts(groups.select("end", "rows", "bytes"), n_shards)
    shard: Column = F.lit(0)
    start: Column = F.lit(0).cast("long")
    for rows in cuts:
        shard = shard + (F.col("pos") >= rows).cast("int")
        start = F.when(F.col("pos") >= rows, F.lit(rows).cast("long")).otherwise(start)
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"),
        (F.col("pos") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(groups: DataFrame, n: int) -> list[int]:
    """Rows before each cut.  groups: a row for each group with its running end, rows and own bytes."""
    total, largest, rows = groups.agg(F.max("end"), F.max("bytes"), F.max("rows")).first()
    if not total:
        return []
    known: dict[int, int] = {0: 0, total: rows}
    low, high = max(-(-total // n), largest), total
    places = [(0, total)]
    while True:
        bins = _boundaries(groups, places)
        exact = all(count <= 2 for *_, count in bins)
        for first, first_rows, last, last_rows, _ in bins:
            known[first], known[last] = first_rows, last_rows
        ends = sorted(known)
        high = min(high, _least(lambda c: _fits(ends, c, n, total), low, high))
        if exact:
            break
        # Between a bin's first and last boundary any place may be one; elsewhere the known ones are all.
        open_bins = sorted((first, last) for first, _, last, _, count in bins if count > 2)
        low = _least(lambda c: _reach(ends, open_bins, c, n) >= total, low, high)
        if low == high:
            break
        a, b, places = 0, 0, []
        for _ in range(n - 1):
            a = max(a, ends[bisect_right(ends, min(total, a + low)) - 1])
            b = _upper(ends, open_bins, min(total, b + high))
            if a < b:
                places.append((a, b))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(places):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        if not merged:
            break
        places = merged
    return [known[e] for e in _even(sorted(known), high, n, total)]


def _boundaries(groups: DataFrame, places: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """First and last boundary, with their rows, and number of boundaries of each bin of the places."""
    end, width_bins, which = F.col("end"), max(16, GRID * 16 // len(places)), F.lit(None).cast("long")
    for k, (a, b) in enumerate(places):
        bin_of = k * (width_bins + 1) + F.floor((end - a) * F.lit(width_bins) / F.lit(b - a))
        which = F.when((end >= a) & (end <= b), bin_of.cast("long")).otherwise(which)
    found = groups.select("end", "rows", which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin")
    found = found.agg(F.min("end"), F.min("rows"), F.max("end"), F.max("rows"), F.count("*"))
    return [tuple(r)[1:] for r in found.collect()]


def _least(holds, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _fits(ends: list[int], capacity: int, n: int, total: int) -> bool:
    at = 0
    for _ in range(n):
        at = ends[bisect_right(ends, at + capacity) - 1]
    return at >= total


def _upper(ends: list[int], open_bins: list[tuple[int, int]], x: int) -> int:
    k = bisect_right(open_bins, (x, float("inf"))) - 1
    return x if k >= 0 and open_bins[k][0] <= x <= open_bins[k][1] else ends[bisect_right(ends, x) - 1]


def _reach(ends: list[int], open_bins: list[tuple[int, int]], capacity: int, n: int) -> int:
    at = 0
    for _ in range(n):
        at = _upper(ends, open_bins, min(at + capacity, ends[-1]))
    return at


def _even(ends: list[int], capacity: int, n: int, total: int) -> list[int]:
    """Cuts near the even places such that no shard exceeds the capacity."""
    needs = [total]  # needs[k]: the leftmost end from which k more shards reach the total
    for _ in range(n - 1):
        k = bisect_right(ends, needs[-1] - capacity - 1)
        needs.append(ends[k] if needs[-1] > capacity else 0)
    at, cuts = 0, []
    for left in range(n, 1, -1):
        low, high = max(at, needs[left - 1]), ends[bisect_right(ends, min(total, at + capacity)) - 1]
        ideal = at + (total - at) / left
        k = bisect_right(ends, ideal)
        near = min((e for e in ends[max(0, k - 1) : k + 1]), key=lambda e: abs(e - ideal))
        at = min(max(near, low), high)
        cuts.append(at)
    return cuts
