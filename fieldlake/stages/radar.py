"""Radar: backscatter statistics per key from the window's composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import RadarConfig
from fieldlake.functions.raster import rvi, vv_vh_ratio_linear
from fieldlake.naming import KEYS
from fieldlake.operators.grids import focal_median
from fieldlake.operators.joins import asof_nearest, window_join
from fieldlake.operators.zonal import median_composite, pivot_stats, suppress_zero, zonal_stats
from fieldlake.plans.requests import sar_requests, source_rows
from fieldlake.session import cut_lineage, shuffled
from fieldlake.sources.scenes import scene_pixels, select_scenes
from fieldlake.stages.common import PLACE, near_pixels, region_pixels, scenes_in_windows


def despeckled(requests: DataFrame, scenes: DataFrame, pixels: DataFrame, cfg: RadarConfig) -> DataFrame:
    """Filtered VV and VH pixels inside each place's circle.

    The filter runs only on pixels near some place, with a rim wide enough for the neighbourhood.
    """
    usable = scene_pixels(scenes_in_windows(select_scenes(scenes, "S1", radar=cfg), requests, cfg.window_days), pixels.filter(F.col("product") == "S1"), list(cfg.polarisations))
    slim = usable.select("scene_id", "scene_ts", "band", "px_row", "px_col", "lat", "lon", "value")
    near = near_pixels(requests, slim, cfg.buffer_m + 2.0 * cfg.pixel_m)
    smooth = focal_median(near, ["scene_id", "band"], carry=["scene_ts", "lat", "lon"])
    region = region_pixels(requests, smooth, cfg.buffer_m)
    return region.select(*PLACE, "scene_id", F.to_date("scene_ts").alias("obs_date"), "band", "px_row", "px_col", "value")


def radar_layers(composite: DataFrame) -> DataFrame:
    """VV, VH, their linear ratio and RVI per key and pixel, long."""
    pixel = [*KEYS, "px_row", "px_col"]
    at = lambda b: F.max(F.when(F.col("band") == b, F.col("value"))).alias(b)
    wide = composite.groupBy(*pixel).agg(at("VV"), at("VH")).withColumns({
        "VVVH_ratio": vv_vh_ratio_linear(F.col("VV"), F.col("VH")), "RVI": rvi(F.col("VV"), F.col("VH")),
    })
    return wide.unpivot(pixel, ["VV", "VH", "VVVH_ratio", "RVI"], "variable", "value").filter(F.col("value").isNotNull())


def radar_stage(plan: DataFrame, scenes: DataFrame, pixels: DataFrame, cfg: RadarConfig = RadarConfig()) -> DataFrame:
    """One row per key: mean, stdDev, min, max of every group asked for; zeros are left out, empty rows go."""
    requests = cut_lineage(sar_requests(source_rows(plan, "radar"), cfg))
    region = despeckled(requests, scenes, pixels, cfg)
    anchors = requests.select(*KEYS).withColumnRenamed("date", "anchor_date")
    if cfg.mode == "nearest":
        seen = region.select(*PLACE, "obs_date", "scene_id").distinct()
        pick = asof_nearest(anchors, seen, PLACE, cfg.window_days, ["scene_id"]).drop("obs_date")
        hits = shuffled(pick).join(region, [*PLACE, "scene_id"])
    else:
        hits = window_join(anchors, region, PLACE, cfg.window_days, cfg.window_days, "left")
    composite = median_composite(hits.withColumnRenamed("anchor_date", "date"), [*KEYS, "band", "px_row", "px_col"])
    stats = zonal_stats(radar_layers(composite), [*KEYS, "variable"], cfg.statistics)
    asked = requests.select(*KEYS, F.explode("groups").alias("variable"))
    kept = suppress_zero(shuffled(asked).join(stats, [*KEYS, "variable"]), "radar")
    return pivot_stats(kept, KEYS, list(cfg.default_groups), list(cfg.statistics))
