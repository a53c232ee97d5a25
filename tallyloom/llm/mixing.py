"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.ordered import positioned
from tallyloom.storage import materialise

#: Source weights, repeated over the sources in code-point order.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MOST_EPOCHS = 3
#: Documents that may still fit are gone through one by one, a source in a task, if they are no more than these.
TAIL = 100_000


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document a mix takes whose sources come near target weights.

    Size is the number of runs of characters other than space and U+0009 to U+000D.  Sources in
    code-point order, null last, weigh ``weights`` in turn and share the words of all documents; a
    target stops at ``most_epochs`` times its source's size and the excess goes to the others by
    weight.  A source gives whole passes while they fit; the rest goes to the documents of smallest
    -ln(u)/w, where u is a hash of the id and w the document's quality weight, while the sum of their sizes
    stays within the words left.  A document that does not fit is passed over and those behind it that
    still fit are taken in turn.  When none does, of those passed over the one whose size comes nearest to what
    is still missing, the first by key of several, is taken as well if this comes nearer the target.

    ``quality`` (id, quality) weighs a document 0.5 + its mean quality, absent or null quality 1.
    Returns id, ``carry`` columns, size, source_size, target, times, taken.  Null or empty texts have
    size 0 and are taken in whole passes only.  Null sources are one source.  Rows with the same id
    are separate rows and may share a key.  An empty table gives no rows.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *(F.col(c).alias(f"_c_{c}") for c in carry),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )
    if quality is not None:
        graded = quality.select(F.col(quality.columns[0]).alias("_q_id"), F.col(quality.columns[1]).alias("_q"))
        graded = graded.groupBy("_q_id").agg(F.avg("_q").alias("_q"))
        sized = sized.join(graded, sized["doc_id"] == graded["_q_id"], "left").drop("_q_id")
    else:
        sized = sized.withColumn("_q", F.lit(None).cast("double"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(2.0**53)
    weight = F.when(F.col("_q").isNull() | F.isnan("_q"), 1.0).otherwise(0.5 + F.greatest(F.col("_q"), F.lit(0.0)))
    keyed = sized.withColumn("_key", -F.log(u) / weight).drop("_q")
    keyed = materialise(keyed, "mix-keys")
    placed = positioned(keyed, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")], "size", "mix-rows", "source")
    placed = materialise(placed, "mix-placed")
    shares = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    shares = shares.withColumnRenamed("source", "_s")
    joined = placed.join(shares, F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - epochs * F.col("source_size")
    joined = joined.withColumns({"_epochs": epochs, "_left": left, "_within": (F.col("upto") <= left) & (F.col("size") > 0)})
    filled = joined.groupBy("_s").agg(F.coalesce(F.max(F.when(F.col("_within"), F.col("upto"))), F.lit(0)).alias("_filled")).withColumnRenamed("_s", "_f")
    gap = F.col("_left") - F.col("_filled")
    behind = joined.filter("NOT _within AND size > 0").join(filled, F.col("_s").eqNullSafe(F.col("_f"))).select("source", "pos", "size", gap.alias("gap"))
    later = materialise(_fitting(behind), "mix-later")
    used = later.groupBy("source").agg(F.sum("size").alias("_used")).withColumnRenamed("source", "_u")
    passed = behind.join(later.select(F.col("source").alias("_t"), F.col("pos").alias("_at")), F.col("source").eqNullSafe(F.col("_t")) & (F.col("pos") == F.col("_at")), "left_anti")
    passed = passed.join(used, F.col("source").eqNullSafe(F.col("_u")), "left")
    missing = F.col("gap") - F.coalesce("_used", F.lit(0))
    last = passed.filter(F.abs(missing - F.col("size")) < missing).groupBy("source").agg(F.min(F.struct(F.abs(missing - F.col("size")).alias("off"), "pos")).alias("_last")).select("source", "_last.pos")
    extra = later.select("source", "pos").unionByName(last).select(F.col("source").alias("_l"), F.col("pos").alias("_at"))
    joined = joined.join(extra, F.col("_s").eqNullSafe(F.col("_l")) & (F.col("pos") == F.col("_at")), "left")
    more = F.col("_within") | F.col("_at").isNotNull()
    times = F.least(F.col("_epochs") + F.when(more, 1).otherwise(0), F.lit(most_epochs)).cast("long")
    return joined.withColumn("times", times).select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), *(F.col(f"_c_{c}").alias(c) for c in carry), "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).alias("taken"),
    )


def _fitting(behind: DataFrame) -> DataFrame:
    """source, pos and size of the documents that are taken where each, in order of pos, is taken if it fits its source's gap."""
    kind = behind.schema["source"].dataType.simpleString()
    schema, taken, rest = f"source {kind}, pos long, size long", [], behind
    while True:
        rest = materialise(rest.filter("size <= gap"), "mix-rest")
        if rest.count() <= TAIL:
            taken.append(rest.groupBy("source").applyInArrow(_in_turn, schema))
            return reduce(DataFrame.unionAll, taken)
        # sums up to the first that crosses the gap; those behind it meet a smaller gap
        order = [F.col("source").asc_nulls_last(), F.col("_at")]
        summed = materialise(positioned(rest.withColumnRenamed("pos", "_at"), order, "size", "mix-round", "source"), "mix-summed")
        fits = summed.filter("upto <= gap")
        taken.append(fits.select("source", F.col("_at").alias("pos"), "size"))
        used = fits.groupBy(F.col("source").alias("_u")).agg(F.max("upto").alias("_used"))
        rest = summed.filter("upto > gap").join(used, F.col("source").eqNullSafe(F.col("_u"))).select("source", F.col("_at").alias("pos"), "size", (F.col("gap") - F.col("_used")).alias("gap"))


def _in_turn(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    gap, own = table.column("gap")[0].as_py(), []
    for k, size in enumerate(table.column("size").to_pylist()):
        if size <= gap:
            gap -= size
            own.append(k)
    return table.take(pa.array(own, pa.int64())).select(["source", "pos", "size"])


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """source, source_size and target of each source, by filling up to the caps."""
    order = [F.col("source").asc_nulls_last()]
    ranked = positioned(sources, order, "source_size", "mix-sources")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", turn.alias("_w")), "mix-targets")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while True:
        held, free = ranked.agg(
            F.coalesce(F.sum(F.when(capped, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0))
        ).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
        capped = F.lit(level) * F.col("_w") >= most * F.col("source_size")
    target = F.when(F.lit(level) * F.col("_w") >= most * F.col("source_size"), (most * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", target.otherwise(F.lit(level) * F.col("_w")).alias("target"))
