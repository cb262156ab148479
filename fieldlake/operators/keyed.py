"""Row choice per key, gap filling and frame union.

Choice per key is an aggregate, not a window: partial aggregation leaves one
candidate row per key and task, so a key holding much of the table costs no
single task a sort of its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.naming import KEYS, STAT_SUFFIX, col
from fieldlake.session import cut_lineage

SLICE_DAYS = 256  # of a history in one task


def _row(columns: list[str]) -> Column:
    return F.struct(*(col(c) for c in columns))


def dedup_first(df: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None) -> DataFrame:
    """First row of each key in the given order; equal order values are settled by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranking = [*(order or []), *(c for c in rest if c not in (order or []))]
    best = F.min_by(_row(rest), _row(ranking)).alias("_row")
    out = df.groupBy(*map(col, keys)).agg(best)
    return out.select(*(col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def collapse_duplicates(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Row of each key with the most filled cells; ties are settled by the cell values."""
    rest = [c for c in df.columns if c not in keys]
    filled = sum((col(c).isNotNull().cast("int") for c in rest), F.lit(0))
    best = F.max_by(_row(rest), F.struct(filled.alias("n"), _row(rest).alias("r"))).alias("_row")
    out = df.groupBy(*map(col, keys)).agg(best)
    return out.select(*(col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def first_non_null(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key and column, the first value that is not null; columns are independent."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picks = [
        F.min_by(col(c), F.when(col(c).isNotNull(), _row([*order, c]))).alias(c) for c in rest
    ]
    return df.groupBy(*map(col, keys)).agg(*picks)


def _slice(df: DataFrame, name: str) -> Column:
    """A whole number that grows with a date or time, ``SLICE_DAYS`` days each; 0 for other types."""
    if dict(df.dtypes)[name] in ("date", "timestamp", "timestamp_ntz"):
        return F.floor(F.unix_date(col(name).cast("date")) / SLICE_DAYS)
    return F.lit(0).cast("bigint")


def interpolate_linear(
    df: DataFrame, columns: list[str], partition: list[str], order: list[str], slice_by: Column | None = None
) -> DataFrame:
    """Fill gaps on the line between neighbouring known rows, by row position; ends take the nearest value.

    Neighbours are searched inside ``partition`` (a location's own history). A
    history is worked on in slices of time, so a long one is spread over many
    tasks: each slice tells its size and its first and last known values, these
    are carried across the slices of a location, and gaps are filled inside.
    ``slice_by`` must not fall as the rows go on in ``order``; the default cuts
    by the first order column where it is a date or a time.
    """
    keys = list(map(col, partition))
    cut = _slice(df, order[0]) if slice_by is None else slice_by
    inside = Window.partitionBy(*keys, "_slice").orderBy(*map(col, order))
    # written, so that rows equal in order keep their places in both uses
    numbered = cut_lineage(df.withColumn("_slice", cut).withColumn("_in", F.row_number().over(inside)))
    spot = lambda name, place: F.when(col(name).isNotNull(), F.struct(place.alias("p"), col(name).cast("double").alias("v")))
    ends = [f(spot(name, F.col("_in"))).alias(f"_{end}{i}") for i, name in enumerate(columns) for f, end in ((F.min, "first"), (F.max, "last"))]
    slices = numbered.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"), *ends)
    along = Window.partitionBy(*keys).orderBy("_slice")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    slices = slices.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["p"] + F.col("_start")).alias("p"), F.col(c)["v"].alias("v")))
    carried = [x for i in range(len(columns)) for x in (
        F.last(moved(f"_last{i}"), ignorenulls=True).over(earlier).alias(f"_before{i}"), F.first(moved(f"_first{i}"), ignorenulls=True).over(later).alias(f"_after{i}"))]
    slices = slices.select(*(col(k).alias(f"_k{i}") for i, k in enumerate(partition)), F.col("_slice").alias("_k"), "_start", *carried)
    same = numbered["_slice"].eqNullSafe(slices["_k"])
    for i, k in enumerate(partition):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = numbered.join(slices, same).withColumn("_pos", F.col("_start") + F.col("_in"))
    before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    helpers = {}
    for i, name in enumerate(columns):
        helpers[f"_lo{i}"] = F.coalesce(F.last(spot(name, F.col("_pos")), ignorenulls=True).over(before), F.col(f"_before{i}"))
        helpers[f"_hi{i}"] = F.coalesce(F.first(spot(name, F.col("_pos")), ignorenulls=True).over(after), F.col(f"_after{i}"))
    found = rows.withColumns(helpers)

    def filled(i: int, name: str) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        slope = (hi["v"] - lo["v"]) / (hi["p"] - lo["p"])
        inner = lo["v"] + slope * (F.col("_pos") - lo["p"])
        return F.coalesce(col(name).cast("double"), F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(inner))

    values = {name: filled(i, name) for i, name in enumerate(columns)}
    return found.select(*(values[c].alias(c) if c in values else col(c) for c in df.columns))


def drop_all_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows whose statistics are all zero (at least one known, every known one zero)."""
    columns = columns if columns is not None else [c for c in df.columns if STAT_SUFFIX.search(c)]
    if not columns:
        return df
    size = F.greatest(*(F.abs(col(c)) for c in columns)) if len(columns) > 1 else F.abs(col(columns[0]))
    return df.filter(size.isNull() | (size != 0))


def stats_view(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys and the mean/min/max columns only."""
    wanted = [c for c in df.columns if c.endswith(("__mean", "__min", "__max"))]
    return df.select(*map(col, keys), *map(col, wanted))


def union_stages(frames: list[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reorder_priority(df: DataFrame, first: list[str], drop: list[str] | None = None) -> DataFrame:
    """Named columns first, the rest as they were; ``drop`` columns are left out."""
    dropped = set(drop or [])
    names = [c for c in df.columns if c not in dropped]
    lead = [c for c in first if c in names]
    return df.select(*map(col, lead), *(col(c) for c in names if c not in lead))


def top_k(df: DataFrame, by: str, k: int, tie: str | None = None) -> DataFrame:
    """Largest k rows; each task keeps only its own k."""
    order = [col(by).desc_nulls_last()] + ([col(tie)] if tie else [])
    return df.orderBy(*order).limit(k)
