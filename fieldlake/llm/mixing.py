"""Mixing sources to target weights by entropy balancing.

Among all document rates the one nearest to 1 (least sum of r log r - r + 1)
that gives every source its target of words, no rate above ``MAX_COPIES``, is
r = min(MAX_COPIES, exp(multiplier of the source * size / mean size of the
source)). The multipliers solve the convex dual, whose gradient is words taken
minus target. Newton steps, kept inside a bracket, are one aggregation each over
the counts of documents per (source, size), which hold all the dual needs.

Rates become copies by systematic rounding: inside slices of about
``SLICE_ROWS`` documents of one source, in order of size, the running sum of the
rates is rounded, so that the words of a slice miss by less than one document.
A few repairs, one document per source each, close what is left in small
sources. All is DataFrame work; the driver holds only counters.

Defined cases: a null or blank text has size 0, rate 1 and adds no words; a null
source is a source of its own, the last; repeated rows are documents of their
own; a table without words has targets 0; an empty table gives an empty result;
extra columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import SPACE, col
from fieldlake.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SLICE_ROWS = 1000
STEPS = 60
REPAIRS = 6
TOLERANCE = 1e-9
NEAR = 1e-3
ONE = 1_000_000_000  # rates are kept as whole billionths, so sums of rates do not depend on their order


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """Add target to (source, source_size, ...): shares of the total by repeating weights in order of source, null last.

    A target stops at ``cap`` times its source's size; what is over goes to the others by weight until none is above.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # places in the order of all sources: ranges, then the rows before each range
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(sizes), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_off")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = ranged.join(before.select("_part", "_off"), "_part").withColumn("weight", F.get(cycle, (place % len(weights)).cast("int")))
    rows = cut_lineage(rows.drop("_part", "_off"))
    top = F.col("source_size") * float(cap)
    share, capped = 0.0, -1
    while True:  # the share of a unit of weight only grows, so a capped source stays capped
        full = top <= F.col("weight") * share
        n, held, free = rows.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, top).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        capped, share = n, (total - held) / free
    return rows.withColumn("target", F.least(F.col("weight") * share, top))


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def _tilts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, tilt): Newton steps on the dual, each one aggregation over the counts."""
    state = sources.select(
        "source", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(-50.0).alias("low"), F.lit(math.inf).alias("high"),
        (F.col("source_size") <= 0).alias("done"),
    )
    state = cut_lineage(state)
    for _ in range(STEPS):
        live = state.filter(~F.col("done")).select(F.col("source").alias("s"), "tilt", "mean")
        words = F.col("n") * F.col("size")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        free = F.when(rate < MAX_COPIES, rate).otherwise(0.0)
        sums = counts.join(live, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(words * rate).alias("got"), F.sum(words * free * F.col("size") / F.col("mean")).alias("slope"),
            F.max(F.when(F.col("size") > 0, F.log(F.lit(float(MAX_COPIES))) * F.col("mean") / F.col("size"))).alias("edge"),
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("got") - F.col("target")
        low = F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.least(F.when(over > 0, F.least("high", "tilt")).otherwise(F.col("high")), "edge")
        moved = joined.withColumn("low", F.coalesce(low, "low")).withColumn("high", F.coalesce(high, "high"))
        # Newton on the logarithm of the words, which is nearly straight; else the middle of the bracket
        step = F.col("tilt") + F.log(F.try_divide("target", "got")) * F.try_divide("got", "slope")
        inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
        near = F.coalesce(F.abs(over) <= TOLERANCE * F.col("target"), F.lit(True))
        tight = F.col("high") - F.col("low") <= 1e-12
        state = cut_lineage(moved.select(
            "source", "target", "mean", "low", "high",
            F.when(F.col("done") | near, F.col("tilt")).when(inside, step).when(
                F.col("high") == math.inf, F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            (F.col("done") | near | tight).alias("done"),
        ))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select(F.col("source").alias("s"), F.round("tilt", 10).alias("tilt"))


def _copies(rows: DataFrame) -> DataFrame:
    """Round rates to copies by the running sum of rates, in slices of sources, in order of size."""
    order = Window.partitionBy("source", "_slice").orderBy("size", "doc_id", "_tie")
    upto = F.sum("_parts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64(F.lit("start"), "source", "_slice"), F.lit(ONE))
    floor = lambda x: F.floor(x / ONE)
    rows = rows.withColumn("_upto", upto + start).withColumn("_no", F.row_number().over(order))
    copies = floor(F.col("_upto")) - floor(F.col("_upto") - F.col("_parts"))
    return rows.withColumn("copies", F.least(copies, F.lit(MAX_COPIES)).cast("bigint")).drop("_upto", "_parts", "_tie")


def _repair(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Change one document of a source by one copy at a time while that brings the source clearly nearer to its target."""
    changes = None
    for _ in range(REPAIRS):
        now = rows if changes is None else rows.join(changes, ["_slice", "_no", "_key"], "left").withColumn(
            "copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        taken = now.groupBy("_key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        gaps = sources.join(taken, "_key").select("_key", (F.col("target") - F.col("taken")).alias("gap"), "target")
        gaps = cut_lineage(gaps.filter(F.abs("gap") > F.greatest(NEAR * F.col("target"), F.lit(0.5))))
        if gaps.isEmpty():
            break
        left = F.col("gap") - F.signum("gap") * F.col("size")
        able = F.when(F.col("gap") > 0, F.col("copies") < MAX_COPIES).otherwise(F.col("copies") > 0)
        best = now.join(gaps, "_key").filter(able & (F.abs(left) < F.abs("gap"))).groupBy("_key").agg(F.min(F.struct(
            F.abs(left).alias("left"), "doc_id", "_slice", "_no", F.signum("gap").cast("bigint").alias("change"))).alias("b"))
        new = best.select("b._slice", "b._no", "_key", "b.change")
        new = cut_lineage(new if changes is None else changes.unionByName(new).groupBy("_slice", "_no", "_key").agg(F.sum("change").alias("change")))
        if changes is not None and new.exceptAll(changes).isEmpty() or changes is None and new.isEmpty():
            break
        changes = new
    if changes is None:
        return rows
    return rows.join(changes, ["_slice", "_no", "_key"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def mix_sources(
    docs: DataFrame, text: str = "text", id_name: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies, taken."""
    rows = cut_lineage(docs.select(
        col(id_name).cast("bigint").alias("doc_id"), col(source).cast("string").alias("source"), word_count(col(text).cast("string")).alias("size"),
    ))
    counts = cut_lineage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = source_targets(sources, weights).withColumn("mean", F.col("source_size") / F.col("docs"))
    sources = cut_lineage(sources.withColumn("_key", F.xxhash64("source", F.col("source").isNull())))
    tilts = _tilts(counts, sources)
    plan = cut_lineage(sources.join(tilts, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    known = plan.select(F.col("source").alias("s"), "_key", "source_size", "target", "docs", "mean", "tilt")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("mean"))).otherwise(1.0)
    slices = F.ceil(F.col("docs") / slice_rows).cast("bigint")
    ready = joined.withColumn("_parts", F.round(rate * ONE).cast("bigint")).withColumn("rate", F.round(rate, 9)).withColumn(
        "_slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id", "size"), slices)).withColumn("_tie", F.lit(0)).drop("docs", "mean", "tilt")
    made = cut_lineage(_copies(ready))
    made = _repair(made, plan.select("_key", "target"))
    return made.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
