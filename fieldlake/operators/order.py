"""Exact quantiles and ranks of whole columns.

A column's order statistics must not gather the column in one task. Quantiles
are found by counting leading bits; ranks come from ranges of the values and
the counts of the ranges before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.naming import col
from fieldlake.session import at_most, cut_lineage, salted_join, short_lived

RADIX_BITS = 11
BROADCAST_ROWS = 10_000
RANGE_ROWS = 1 << 18  # rows that are ranked together
FEW_ROWS = 1 << 18  # rows whose values are counted whole
SHIFTS = [max(0, 64 - RADIX_BITS * i) for i in range(1, 7)]  # bits still unknown after each pass


def unpivot(df: DataFrame, columns: list[str], ids: list[str] | None = None, name: str = "feature", value: str = "x") -> DataFrame:
    """Wide to long with double values; nulls (and NaN) are left out."""
    ids = ids or []
    wide = df.select(*map(col, ids), *(col(c).cast("double").alias(c) for c in columns))
    long = wide.unpivot(list(map(col, ids)), list(map(col, columns)), name, value)
    return long.filter(col(value).isNotNull() & ~F.isnan(col(value)))


# ---- quantiles ------------------------------------------------------------
#
# The bits of a double, with those of negative numbers turned over, are whole
# numbers in the order of the doubles. A wanted rank is found by their leading
# bits, RADIX_BITS more in each pass: count the rows per value of the next bits
# among those that share the bits found so far, and take the value that holds
# the rank. Six passes settle any column, whatever its range or ties.

def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_ordered_bits(o: np.ndarray) -> np.ndarray:
    return (o ^ ((o >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _between(p: float, n: int) -> tuple[int, int, float]:
    """The two ranks a quantile lies between, and how far on its way."""
    place = p * (n - 1)
    return math.floor(place), math.ceil(place), place - math.floor(place)


def grouped_quantiles(long: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: keys, p, value. Nulls and NaN are left out."""
    if not keys:
        raise ValueError("name at least one key column")
    data = long.select(*map(col, keys), col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    group = list(map(col, keys))
    data = cut_lineage(_swapped(data, "_v", "_o", T.LongType(), ordered_bits))
    counts = cut_lineage(data.groupBy(*group, F.shiftright("_o", SHIFTS[0]).alias("_p")).agg(F.count("*").alias("_c")))
    place = F.col("p") * (F.col("_n") - 1)
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    wanted = cut_lineage(sizes.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probs)))).select(
        *group, "p", F.floor(place).alias("_k0"), F.ceil(place).alias("_k1"), (place - F.floor(place)).alias("_f")
    ))
    ranks = wanted.select(*group, F.explode(F.array("_k0", "_k1")).alias("_k")).distinct()
    state = ranks.withColumns({"_prefix": F.lit(0).cast("bigint"), "_below": F.lit(0).cast("bigint")})
    counts = counts.withColumn("_prefix", F.lit(0).cast("bigint"))
    for before, shift in zip([None, *SHIFTS], SHIFTS):
        if before is not None:
            marked, open_ = data.withColumn("_prefix", F.shiftright("_o", before)), state.select(*group, "_prefix").distinct()
            on = [*keys, "_prefix"]
            inside = marked.join(F.broadcast(open_), on, "left_semi") if at_most(open_, BROADCAST_ROWS) else salted_join(marked, open_, on, "left_semi")
            counts = inside.groupBy(*group, "_prefix", F.shiftright("_o", shift).alias("_p")).agg(F.count("*").alias("_c"))
        running = F.sum("_c").over(Window.partitionBy(*group, "_prefix").orderBy("_p"))
        met = counts.withColumn("_t", running).join(state, [*keys, "_prefix"])
        holds = (F.col("_below") + F.col("_t") > F.col("_k")) & (F.col("_below") + F.col("_t") - F.col("_c") <= F.col("_k"))
        state = cut_lineage(met.filter(holds).select(*group, "_k", F.col("_p").alias("_prefix"), (F.col("_below") + F.col("_t") - F.col("_c")).alias("_below")))
    found = _swapped(state.drop("_below"), "_prefix", "_at", T.DoubleType(), from_ordered_bits)
    low, high = (found.select(*group, F.col("_k").alias(k), F.col("_at").alias(v)) for k, v in (("_k0", "_a"), ("_k1", "_z")))
    both = wanted.join(low, [*keys, "_k0"]).join(high, [*keys, "_k1"])
    spot = (F.lit(1.0) - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_z")
    return both.select(*group, "p", F.when(F.col("_f") == 0, F.col("_a")).otherwise(spot).alias("value"))


def _swapped(df: DataFrame, old: str, new: str, kind: T.DataType, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A column without nulls replaced by what is made of its values, batch by batch."""
    names = df.columns
    schema = T.StructType([T.StructField(new, kind) if f.name == old else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(work(batch.column(i).to_numpy(zero_copy_only=False))) if n == old else batch.column(i) for i, n in enumerate(names)], names=schema.names
            )

    return df.mapInArrow(run, schema)


def _pass(wide: DataFrame, wanted: list[np.ndarray], before: int | None, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per column the next prefixes of values whose prefix is wanted, in order, and their counts: at most 2^RADIX_BITS per wanted prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for f in range(len(wanted)):
                x = batch.column(f).to_numpy(zero_copy_only=False)
                o = ordered_bits(x[~np.isnan(x)])
                if before is not None:
                    o = o[np.isin(o >> before, wanted[f])]
                fresh = np.unique(o >> shift, return_counts=True)
                if f in held:
                    values, at = np.unique(np.concatenate([held[f][0], fresh[0]]), return_inverse=True)
                    fresh = values, np.bincount(at, np.concatenate([held[f][1], fresh[1]]), len(values)).astype(np.int64)
                held[f] = fresh
        for f, (values, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["f", "v", "c"])

    rows = wide.mapInArrow(count, "f int, v bigint, c bigint").groupBy("f", "v").agg(F.sum("c").alias("c")).toPandas()
    return {f: (g["v"].to_numpy(), g["c"].to_numpy()) for f, g in rows.sort_values(["f", "v"]).groupby("f")}


def order_statistics(wide: DataFrame, ranks: Callable[[int], list[int]]) -> list[tuple[int, dict[int, float]]]:
    """Per column of a written table of doubles its count of values, and the values at the ranks (from 0) wanted for that count.

    All columns are counted in one scan a pass; only counts per leading bits, of
    which there are a fixed number per column and rank, reach the driver. Once no
    more than FEW_ROWS rows share the bits found, one pass counts these whole.
    """
    first = _pass(wide, [np.empty(0, np.int64)] * len(wide.columns), None, SHIFTS[0])
    sizes = {f: int(c.sum()) for f, (_, c) in first.items()}
    state = {f: {k: (0, 0) for k in ranks(n)} for f, n in sizes.items()}  # rank: prefix, rows below it
    before, shift, steps = None, SHIFTS[0], iter(SHIFTS[1:])
    while True:
        left: dict[tuple[int, int], int] = {}  # rows that share the bits found
        wanted = [np.array(sorted({x for x, _ in state.get(f, {}).values()}), np.int64) for f in range(len(wide.columns))]
        counted = first if before is None else _pass(wide, wanted, before, shift)
        for f, places in state.items():
            if not places:
                continue
            values, counts = counted[f]
            own = np.zeros(len(values), np.int64) if before is None else values >> (before - shift)
            for k, (prefix, below) in places.items():
                here = np.flatnonzero(own == prefix)
                through = below + np.cumsum(counts[here])
                i = int(np.searchsorted(through, k, "right"))
                places[k] = (int(values[here[i]]), int(through[i] - counts[here[i]]))
                left[f, places[k][0]] = int(counts[here[i]])
        if not shift or not left:
            break
        before, shift = shift, 0 if sum(left.values()) <= FEW_ROWS else next(steps)
    return [
        (sizes.get(f, 0), {k: float(from_ordered_bits(np.array([x], np.int64))[0]) for k, (x, _) in state.get(f, {}).items()})
        for f in range(len(wide.columns))
    ]


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles of many columns: feature, p, value. Columns without values give no rows."""
    with short_lived(df.sparkSession):
        wide = cut_lineage(df.select(*(col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns))))
        found = order_statistics(wide, lambda n: sorted({k for p in probs for k in _between(p, n)[:2]}))
    rows = []
    for name, (n, at) in zip(columns, found):
        for p in probs if n else []:
            a, z, part = _between(p, n)
            rows.append((name, float(p), at[a] if part == 0 else (1.0 - part) * at[a] + part * at[z]))
    return df.sparkSession.createDataFrame(rows, "feature string, p double, value double")


# ---- ranks ----------------------------------------------------------------

def ranges_for(rows: DataFrame) -> int:
    """Ranges to rank the rows in: as many as keep a task's share bounded, whatever their number."""
    n = rows.count()
    return max(math.ceil(n / RANGE_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 10_000)), 1)


def with_places(
    rows: DataFrame, keys: list[str], value: str, weight: str | None = None, prefix: str = "", ranges: int | None = None
) -> DataFrame:
    """Add to each row how many rows of its group hold its value, how many a smaller one, and the group size.

    The columns are named ``cnt``, ``before`` and ``n`` behind ``prefix``. Rows are cut into ranges of (keys, value,
    hash of the row), so a hot value spreads over several ranges as long as the rows differ (equal rows should come
    as one, or few, with a ``weight``). There are ``ranges`` of them, by default one per RANGE_ROWS rows at least, so what a
    task sorts and buffers does not grow with the table. Rows are counted inside ranges; one small row per range and group gives the counts of
    the ranges before, and settles values that lie across an edge. Rows without a value are left out.
    """
    group, v = list(map(col, keys)), col(value)
    apart = F.xxhash64(*map(col, rows.columns))
    known = rows.filter(v.isNotNull()).withColumn("_w", col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    ranges = ranges or ranges_for(known)
    ranged = known.repartitionByRange(ranges, *group, v, apart).withColumn("_part", F.spark_partition_id())
    ranged = ranged.repartition(ranges, "_part")  # a whole range a task: else the windows would deal the rows to a fixed number of tasks
    inside = Window.partitionBy("_part", *group)
    counted = cut_lineage(ranged.withColumns({
        "_own": F.sum("_w").over(Window.partitionBy("_part", *group, v)),
        "_through": F.sum("_w").over(inside.orderBy(v)),  # equal values included
    }))
    end = F.struct(v.alias("v"), F.col("_own").alias("c"))
    pieces = counted.groupBy("_part", *group).agg(F.max("_through").alias("_t"), F.min(end).alias("_low"), F.max(end).alias("_high"))
    whole = Window.partitionBy(*group)  # at most one row per range and group
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumns({"_start": F.coalesce(F.sum("_t").over(earlier), F.lit(0)), "_n": F.sum("_t").over(whole)})
    edges = F.array_distinct(F.array(  # one entry where a range holds a single value
        F.struct(F.col("_low.v"), F.col("_low.c"), F.col("_start").alias("b")),
        F.struct(F.col("_high.v"), F.col("_high.c"), (F.col("_start") + F.col("_t") - F.col("_high.c")).alias("b")),
    ))
    across = Window.partitionBy(*group, "_e.v")
    settled = starts.withColumn("_e", F.explode(edges)).select(
        "_part", *group, "_start", "_n", F.struct("_e.v", F.sum("_e.c").over(across).alias("c"), F.min("_e.b").over(across).alias("b")).alias("_e")
    )
    small = settled.groupBy(F.col("_part").alias("_p"), *(g.alias(f"_k{i}") for i, g in enumerate(group))).agg(
        F.max("_start").alias("_start"), F.max("_n").alias("_n"), F.min("_e").alias("_low"), F.max("_e").alias("_high")
    )
    on = [F.col("_part") == F.col("_p"), *(g.eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group))]

    def at_edge(name: str, otherwise: Column) -> Column:
        return F.when(v == F.col("_low.v"), F.col(f"_low.{name}")).when(v == F.col("_high.v"), F.col(f"_high.{name}")).otherwise(otherwise)

    return counted.join(small, on).select(
        *map(col, rows.columns), at_edge("c", F.col("_own")).alias(f"{prefix}cnt"),
        at_edge("b", F.col("_start") + F.col("_through") - F.col("_own")).alias(f"{prefix}before"), F.col("_n").alias(f"{prefix}n"),
    )


def value_ranks(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group and distinct value: how many rows hold it, how many are smaller, and the group size."""
    counts = long.filter(col(value).isNotNull()).groupBy(*map(col, keys), col(value)).agg(F.count("*").alias("_rows"))
    return with_places(cut_lineage(counts), keys, value, "_rows").drop("_rows")


def mean_rank(before: Column, cnt: Column) -> Column:
    """1-based rank where equal values share the mean of their places."""
    return before + (cnt + 1) / F.lit(2.0)


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank per distinct value of each group."""
    ranks = value_ranks(df, keys, value)
    return ranks.select(*map(col, keys), col(value), "cnt", mean_rank(F.col("before"), F.col("cnt")).alias("avg_rank"))
