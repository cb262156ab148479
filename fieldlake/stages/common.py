"""Steps shared by the raster stages."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.naming import KEYS, col
from fieldlake.operators.joins import METRES_PER_DEGREE, asof_earliest, asof_nearest, buffer_join, window_join
from fieldlake.operators.zonal import median_composite, zonal_stats
from fieldlake.session import cut_lineage, shuffled

PLACE = ["latitude", "longitude"]
BLOCK_DEGREES = 5.625
MAX_BOXES = 32


def requested_values(requests: DataFrame, column: str) -> list[str]:
    """Distinct tokens of an array column, sorted: the variables that become columns of the wide result."""
    return sorted(r["v"] for r in requests.select(F.explode(col(column)).alias("v")).distinct().collect())


def places_of(requests: DataFrame) -> DataFrame:
    return requests.select(*PLACE).distinct()


def place_boxes(requests: DataFrame) -> list[tuple[float, float, float, float]]:
    """South, north, west, east of at most MAX_BOXES boxes that hold all requested places.

    Places meet by blocks of a coarse world grid (at most 2145 rows reach the driver); blocks are doubled until few are left.
    """
    lat, lon = col("latitude"), col("longitude")
    block = [F.floor((lat + 90.0) / BLOCK_DEGREES).alias("_i"), F.floor((lon + 180.0) / BLOCK_DEGREES).alias("_j")]
    rows = requests.filter(lat.isNotNull() & lon.isNotNull()).groupBy(*block).agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).collect()
    held = {(int(i), int(j)): box for i, j, *box in rows}
    while len(held) > MAX_BOXES:
        merged: dict[tuple[int, int], list[float]] = {}
        for (i, j), (s, n, w, e) in held.items():
            own = merged.setdefault((i // 2, j // 2), [s, n, w, e])
            merged[i // 2, j // 2] = [min(own[0], s), max(own[1], n), min(own[2], w), max(own[3], e)]
        held = merged
    return [tuple(box) for _, box in sorted(held.items())]


def in_extent(requests: DataFrame, pixels: DataFrame, buffer_m: float) -> DataFrame:
    """Pixels in the boxes round the requested places, as literals that reach the scan.

    Longitudes are left alone where a box would cross the antimeridian or come near a pole.
    """
    inside = F.lit(False)
    for low, high, left, right in place_boxes(requests):
        pad = 1.001 * buffer_m / METRES_PER_DEGREE + 1e-6
        south, north = low - pad, high + pad
        box = col("lat").between(south, north)
        widest = max(abs(south), abs(north))
        if widest < 89:
            pad = pad / math.cos(math.radians(widest))
            west, east = left - pad, right + pad
            if west > -180 and east < 180:
                box = box & col("lon").between(west, east)
        inside = inside | box
    return pixels.filter(inside)


def scenes_in_windows(scenes: DataFrame, requests: DataFrame, days: int) -> DataFrame:
    """Scenes taken in the time from the first to the last requested window, as literals."""
    first, last = requests.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return scenes.filter(F.lit(False))
    ends = (first - datetime.timedelta(days), last + datetime.timedelta(days + 1))
    return scenes.filter((col("scene_ts") >= F.lit(ends[0]).cast("timestamp")) & (col("scene_ts") < F.lit(ends[1]).cast("timestamp")))


def region_pixels(requests: DataFrame, pixels: DataFrame, buffer_m: float) -> DataFrame:
    """Pixels inside each requested place's circle; dates play no part yet, so each place is met once."""
    return buffer_join(places_of(requests), in_extent(requests, pixels, buffer_m), buffer_m)


def near_pixels(requests: DataFrame, pixels: DataFrame, buffer_m: float) -> DataFrame:
    """Pixels near any requested place, each once: input of neighbourhood operators."""
    return buffer_join(places_of(requests), in_extent(requests, pixels, buffer_m), buffer_m, how="left_semi")


def scene_window_stats(
    wanted: DataFrame, region: DataFrame, days: int, pick: str, stats: tuple[str, ...] = ("mean", "min", "max")
) -> DataFrame:
    """Statistics of one scene per key, else of the window's median composite.

    ``wanted``: keys and band. ``region``: place, scene_id, obs_date, band,
    px_row, px_col, value. Scene statistics are taken before dates multiply the
    rows, so an anchor only picks from a table of one row per place, scene and band.
    """
    anchors = wanted.select(*KEYS).distinct().withColumnRenamed("date", "anchor_date")
    scenes = region.select(*PLACE, "obs_date", "scene_id").distinct()
    choose = asof_nearest if pick == "nearest" else asof_earliest
    picked = choose(anchors, scenes, PLACE, days, ["scene_id"]).select(*PLACE, "anchor_date", "scene_id")
    per_scene = zonal_stats(region, [*PLACE, "scene_id", "band"], stats)
    direct = shuffled(picked).join(per_scene, [*PLACE, "scene_id"]).withColumnRenamed("anchor_date", "date").drop("scene_id")
    found = cut_lineage(shuffled(wanted).join(direct, [*KEYS, "band"]))
    # Only a key with a scene in its window but no value from it has anything to gain from the composite.
    chosen = picked.withColumnRenamed("anchor_date", "date").select(*KEYS)
    empty = wanted.join(shuffled(chosen), KEYS, "left_semi").join(shuffled(found.select(*KEYS).distinct()), KEYS, "left_anti")
    empty = cut_lineage(empty.withColumnRenamed("date", "anchor_date"))
    if empty.isEmpty():
        return found
    hits = window_join(empty, region, [*PLACE, "band"], days, days, "left")
    composite = median_composite(hits, ["anchor_date", *PLACE, "band", "px_row", "px_col"])
    backup = zonal_stats(composite.withColumnRenamed("anchor_date", "date"), [*KEYS, "band"], stats)
    return found.unionByName(backup)
