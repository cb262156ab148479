"""Interval, as-of and spatial-buffer joins, and merging of stage outputs.

Interval joins use equi-keys only: time is cut into slices as long as the
window, so an anchor meets at most two slices and a location with a very long
history is spread over many (location, slice) groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.naming import KEYS, col
from fieldlake.plans.fetch import standardise
from fieldlake.session import BROADCAST_ROWS, at_most, may_broadcast, replicated, salted, salted_join, shuffled

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111194.92664455873  # EARTH_RADIUS_M * pi / 180


# ---- interval joins -------------------------------------------------------

def _epoch_day(day: Column) -> Column:
    return F.unix_date(day.cast("date"))


def window_join(
    anchors: DataFrame,
    obs: DataFrame,
    on: list[str],
    before: int,
    after: int,
    closed: str = "both",
    anchor_date: str = "anchor_date",
    obs_date: str = "obs_date",
) -> DataFrame:
    """Observations with ``anchor - before <= day <= anchor + after`` (``closed='left'``: ``<`` at the end)."""
    last = after if closed == "both" else after - 1
    width = max(before + last + 1, 1)
    start, end = _epoch_day(col(anchor_date)) - before, _epoch_day(col(anchor_date)) + last
    slot = lambda day: F.floor(day / F.lit(width))
    spread = anchors.filter(end >= start).withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    sliced = obs.withColumn("_slot", slot(_epoch_day(col(obs_date))))
    day = _epoch_day(col(obs_date))
    return shuffled(spread).join(sliced, [*on, "_slot"]).filter((day >= start) & (day <= end)).drop("_slot")


def nearest_rank(anchor: Column, day: Column) -> Column:
    """Sort value for 'nearest day, the earlier one of two': distance, then date."""
    return F.struct(F.abs(F.datediff(day, anchor)).alias("gap"), day.alias("day"))


def asof_nearest(
    anchors: DataFrame,
    obs: DataFrame,
    on: list[str],
    days: int,
    values: list[str],
    by: list[str] | None = None,
    anchor_date: str = "anchor_date",
    obs_date: str = "obs_date",
) -> DataFrame:
    """Per anchor (and ``by``, such as the parameter): the values of the nearest day in the window."""
    joined = window_join(anchors, obs, on, days, days, "both", anchor_date, obs_date)
    group = [*anchors.columns, *(by or [])]
    pick = F.min_by(F.struct(col(obs_date), *map(col, values)), nearest_rank(col(anchor_date), col(obs_date)))
    out = joined.groupBy(*map(col, group)).agg(pick.alias("_pick"))
    return out.select(*map(col, group), *(F.col("_pick")[c].alias(c) for c in [obs_date, *values]))


def asof_earliest(
    anchors: DataFrame,
    scenes: DataFrame,
    on: list[str],
    days: int,
    values: list[str],
    by: list[str] | None = None,
    anchor_date: str = "anchor_date",
    obs_date: str = "obs_date",
) -> DataFrame:
    """Per anchor: the first scene of ``[anchor - days, anchor + days)``."""
    joined = window_join(anchors, scenes, on, days, days, "left", anchor_date, obs_date)
    group = [*anchors.columns, *(by or [])]
    pick = F.min(F.struct(col(obs_date), *map(col, values))).alias("_pick")
    out = joined.groupBy(*map(col, group)).agg(pick)
    return out.select(*map(col, group), *(F.col("_pick")[c].alias(c) for c in [obs_date, *values]))


# ---- spatial joins --------------------------------------------------------

def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2.0)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def cells_per_turn(buffer_m: float) -> int:
    """Whole number of cells around the globe, each no narrower than the buffer at the equator."""
    return max(int(360.0 // max(buffer_m / METRES_PER_DEGREE, 1e-4)), 1)


def lat_cell(lat: Column, cells: int) -> Column:
    return F.floor((lat + F.lit(90.0)) * F.lit(cells / 360.0)).cast("int")


def lon_cell(lon: Column, cells: int) -> Column:
    """Cell number, wrapped at the antimeridian."""
    return F.pmod(F.floor((lon + F.lit(180.0)) * F.lit(cells / 360.0)), F.lit(cells)).cast("int")


def with_cell(pixels: DataFrame, buffer_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell of each pixel; a pixel table stored by these columns is pruned and needs no cell shuffle."""
    cells = cells_per_turn(buffer_m)
    return pixels.withColumns({"_clat": lat_cell(col(lat), cells), "_clon": lon_cell(col(lon), cells)})


def covered_cells(points: DataFrame, buffer_m: float) -> DataFrame:
    """One row per point and cell its circle may touch.

    The longitude span widens with 1 / cos(latitude), and is the full turn when the circle holds a pole.
    """
    cells = cells_per_turn(buffer_m)
    delta = buffer_m / EARTH_RADIUS_M
    dlat = F.lit(buffer_m / METRES_PER_DEGREE)
    lat, lon = col("latitude"), col("longitude")
    ratio = F.sin(F.lit(delta)) / F.cos(F.radians(lat))
    holds_pole = (F.abs(lat) + dlat >= 90.0) | (F.abs(ratio) >= 1.0)
    dlon = F.when(holds_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)))
    low, high = F.floor((lon - dlon + 180.0) * (cells / 360.0)), F.floor((lon + dlon + 180.0) * (cells / 360.0))
    lons = F.array_distinct(
        F.transform(F.sequence(low, F.least(high, low + cells - 1)), lambda c: F.pmod(c, F.lit(cells)).cast("int"))
    )
    lats = F.sequence(lat_cell(lat - dlat, cells), lat_cell(lat + dlat, cells))
    return points.withColumn("_clat", F.explode(lats)).withColumn("_clon", F.explode(lons))


def in_covered_cells(cells: DataFrame, covered: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Pixels (with their cells) in the covered cells, or in coarser cells round them: no pixel is shuffled for it.

    Cells are halved in number per axis until at most ``limit`` are left to broadcast, so what passes may be a little
    more than what is covered, never less.
    """
    level = 0
    while True:
        spots = covered.select(F.shiftright("_clat", level).alias("_wlat"), F.shiftright("_clon", level).alias("_wlon")).distinct()
        if at_most(spots, limit):
            break
        level += 1
    here = (F.shiftright("_clat", level) == F.col("_wlat")) & (F.shiftright("_clon", level) == F.col("_wlon"))
    return cells.join(F.broadcast(spots), here, "left_semi")


def buffer_join(
    points: DataFrame, pixels: DataFrame, buffer_m: float, on: list[str] | None = None, salts: int = 8,
    how: str = "inner", broadcast: bool | None = None,
) -> DataFrame:
    """Pixels within ``buffer_m`` of each point: equi-join on the cell, then the exact distance.

    ``points`` has latitude/longitude, ``pixels`` has lat/lon. ``how="left_semi"`` gives each pixel near any point
    once. Points whose covered cells are few (checked) are broadcast, and pixels stay where they are. Otherwise pixels
    are first filtered by covered cells without a shuffle; only those that pass meet the points, by a salted join,
    because one cell may hold a large share of them. ``broadcast`` settles the choice beforehand.
    """
    if how not in {"inner", "left_semi"}:
        raise ValueError(f"buffer_join cannot do {how!r}")
    keys = [*(on or []), "_clat", "_clon"]
    covered, cells = covered_cells(points, buffer_m), with_cell(pixels, buffer_m)
    small = covered.withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(keys)})
    near = [col(k) == col(f"_at{i}") for i, k in enumerate(keys)]
    if may_broadcast(small) if broadcast is None else broadcast:
        small = F.broadcast(small)
    else:
        cells, small = salted(in_covered_cells(cells, covered), salts), replicated(small, salts, "_way")
        near.append(F.col("_salt") == F.col("_way"))
    near.append(haversine_m(col("latitude"), col("longitude"), col("lat"), col("lon")) <= buffer_m)
    joined = cells.join(small, near, how)
    others = [c for c in points.columns if c not in keys] if how == "inner" else []
    return joined.select(*map(col, pixels.columns), *map(col, others))


def filter_bounds(pixels: DataFrame, points: DataFrame, buffer_m: float, salts: int = 8) -> DataFrame:
    """(product, scene_id) of scenes with a pixel inside the buffer of any point."""
    slim = pixels.select("product", "scene_id", "lat", "lon")
    spots = points.select("latitude", "longitude").distinct()
    return buffer_join(spots, slim, buffer_m, salts=salts, how="left_semi").select("product", "scene_id").distinct()


# ---- merging stages -------------------------------------------------------

def suffixed(right: DataFrame, taken: list[str], suffix: str, keys: list[str] = KEYS) -> DataFrame:
    """Rename columns of ``right`` whose name (in any case) is taken."""
    used = {c.lower() for c in taken}
    return right.select(
        *(col(c).alias(c + suffix) if c.lower() in used and c not in keys else col(c) for c in right.columns)
    )


def merge_source(left: DataFrame, right: DataFrame | None, suffix: str, keys: list[str] = KEYS) -> DataFrame:
    """Full outer merge of two standardised frames; clashing right columns take the suffix.

    A missing side, or one without rows, leaves the other as it is.
    """
    if right is None or right.isEmpty():
        return left
    renamed = suffixed(standardise(right, keys), left.columns, suffix, keys)
    return standardise(left, keys).join(renamed, keys, "full_outer")


def attach_meta(master: DataFrame, meta: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Field attributes (one row per key) onto the master."""
    return shuffled(master).join(meta, keys, "left")


def build_master(stages: list[tuple[DataFrame, str]], keys: list[str] = KEYS, unique: bool = False) -> DataFrame:
    """All stages side by side, one row per key.

    Equal to a chain of full outer joins, but as one union and one grouped
    aggregate: every stage row moves once, where the chain would move the
    growing wide row again for each stage. Where several rows of a stage meet in
    one key, as after rounding, the one with the most filled cells is taken
    whole (ties: by its values).
    """
    taken: list[str] = []
    parts: list[tuple[list[str], DataFrame]] = []
    for i, (frame, suffix) in enumerate(stages):
        part = suffixed(standardise(frame, keys, unique=unique), taken, suffix, keys)
        own = [c for c in part.columns if c not in keys]
        taken += own
        filled = sum((col(c).isNotNull().cast("int") for c in own), F.lit(0))
        parts.append((own, part.select(*map(col, keys), F.struct(filled.alias("n"), F.struct(*map(col, own or keys[:1])).alias("r")).alias(f"_s{i}"))))
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for _, p in parts])
    best = tall.groupBy(*map(col, keys)).agg(*(F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(parts))))
    cells = [F.col(f"_s{i}")["r"][c].alias(c) for i, (own, _) in enumerate(parts) for c in own]
    return restore_terrain_names(best.select(*map(col, keys), *cells))


def restore_terrain_names(df: DataFrame, suffix: str = "_srtm") -> DataFrame:
    """Drop the terrain suffix wherever the plain name is free."""
    plain = [f"{b}__{s}" for b in ("elevation", "slope", "aspect", "hillshade") for s in ("mean", "min", "max")]
    return df.withColumnsRenamed(
        {n + suffix: n for n in plain if n + suffix in df.columns and n not in df.columns}
    )
