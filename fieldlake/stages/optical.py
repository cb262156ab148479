"""Optical: vegetation indexes and land products per key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import OpticalConfig
from fieldlake.functions.raster import optical_indexes, scl_clear
from fieldlake.functions.text import product_of, split_list
from fieldlake.naming import KEYS, col, dataset_column
from fieldlake.operators.keyed import drop_all_zero, interpolate_linear
from fieldlake.operators.zonal import pivot_stats, suppress_zero, vci_by_region, year_extremes
from fieldlake.plans.requests import match_bands, optical_requests, source_rows, wants_vci
from fieldlake.session import cut_lineage, shuffled
from fieldlake.sources.scenes import scene_pixels, select_scenes
from fieldlake.stages.common import PLACE, region_pixels, scene_window_stats, scenes_in_windows

INPUT_BANDS = ("B2", "B4", "B5", "B8")
PIXEL = [*PLACE, "scene_id", "obs_date", "px_row", "px_col"]

VCI_PRODUCT = "MOD13Q1"
EXTREME_DAYS = 366  # the condition index compares with the extremes of the calendar year


def is_interpolated(name: str) -> bool:
    """Raw bands, the six indexes and the land products whose gaps over time are filled; other columns stay as they are."""
    # Land product bands
    known = {"NDVI", "EVI", "VCI", "ET", "Fpar_500m", "Gpp", "PsnNet", *optical_indexes(*(F.lit(1.0) for _ in INPUT_BANDS))}
    return name in known or name.startswith("ET") or re.fullmatch(r"B\d{1,2}A?", name) is not None


def product_days(product: str, cfg: OpticalConfig) -> int:
    return cfg.s2_days if product == "S2" else cfg.modis_et_days if product == "MOD16A2" else cfg.modis_days


def s2_layers(region: DataFrame) -> DataFrame:
    """Clear pixels of a region: raw bands and the six indexes, long."""
    classes = F.max(F.when(F.col("band") == "SCL", F.col("value")))
    cells = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in INPUT_BANDS]
    # Pixels of one scene and place: SCL and the input bands meet in one group.
    bands = F.map_from_entries(F.collect_list(F.struct("band", "value")))
    wide = region.groupBy(*PIXEL).agg(classes.alias("_scl"), *cells, bands.alias("_all"))
    clear = wide.filter(scl_clear(F.col("_scl")))
    indexes = optical_indexes(*(F.col(b) for b in INPUT_BANDS))
    made = F.create_map(*(x for n, v in indexes.items() for x in (F.lit(n), v)))
    layers = F.map_concat(F.map_filter("_all", lambda k, v: ~k.isin("SCL", *indexes)), made)
    tall = clear.select(*PIXEL, F.explode(layers).alias("band", "value"))
    return tall.filter(F.col("value").isNotNull())


def _region(rows: DataFrame, scenes: DataFrame, pixels: DataFrame, product: str, cfg: OpticalConfig) -> DataFrame:
    # Only the product of the condition index needs scenes a year round the dates.
    days = product_days(product, cfg) + (EXTREME_DAYS if product == VCI_PRODUCT else 0)
    usable = scene_pixels(scenes_in_windows(select_scenes(scenes, product, cfg), rows, days), pixels.filter(F.col("product") == product))
    near = region_pixels(rows, usable, cfg.buffer_m)
    return near.select(*PLACE, "scene_id", F.to_date("scene_ts").alias("obs_date"), "px_row", "px_col", "band", "value")


def optical_stage(
    plan: DataFrame, scenes: DataFrame, pixels: DataFrame, cfg: OpticalConfig = OpticalConfig(),
    products: tuple[str, ...] = ("S2", "MOD13Q1", "MOD15A2H", "MOD16A2", "MOD17A2H"),
) -> DataFrame:
    """One row per key: plain mean (zeros left out, gaps interpolated) and mean/min/max of each band asked for."""
    rows = source_rows(plan, "optical").withColumn("_product", product_of(col(dataset_column(plan.columns))))
    # The optical rows of the plan are read by every product: written once.
    rows = cut_lineage(rows.select(*KEYS, "variable", "api parameter", "_product"))
    tables, names = [], set()
    for product in products:
        mine = rows.filter(F.col("_product") == product)
        region = _region(mine, scenes, pixels, product, cfg)
        # The pixels inside the circles are a small part of the archive and are read several times: written once.
        region = cut_lineage(s2_layers(region) if product == "S2" else region)
        bands = region.select("band").distinct()
        if product == "S2":
            asked = optical_requests(mine, cfg).select(*KEYS, F.explode(F.concat("raw", "derived")).alias("token"))
        else:
            asked = mine.select(*KEYS, F.explode(split_list(col("api parameter"))).alias("token")).distinct()
        wanted = cut_lineage(match_bands(asked, bands))
        names.update(r["token"] for r in wanted.select("token").distinct().collect())
        stats = scene_window_stats(wanted.select(*KEYS, "band").distinct(), region, product_days(product, cfg), cfg.pick)
        tables.append(shuffled(wanted).join(stats, [*KEYS, "band"]).select(*KEYS, F.col("token").alias("variable"), "mean", "min", "max"))
        if product == VCI_PRODUCT:
            tables.append(_vci_rows(mine, region, cfg))
            names.add("VCI")
    tall = tables[0]
    for t in tables[1:]:
        tall = tall.unionByName(t, allowMissingColumns=True)
    if not cfg.omit_zero_mean:
        ready = tall.withColumn("plain", F.col("mean"))
    else:
        ready = suppress_zero(tall, "optical")
    names = sorted(names)
    wide = pivot_stats(ready, KEYS, names, ["plain", "mean", "min", "max"])
    if "VCI" in names:
        wide = wide.drop("VCI__mean", "VCI__min", "VCI__max")
    filled = interpolate_linear(wide, [n for n in names if n in wide.columns and is_interpolated(n)], PLACE, ["date"])
    return drop_all_zero(filled)


def _vci_rows(rows: DataFrame, region: DataFrame, cfg: OpticalConfig) -> DataFrame:
    """Vegetation condition index of the keys that ask for it, from the same product throughout."""
    keys = wants_vci(rows).filter("wants_vci").select(*KEYS)
    ndvi = region.filter(F.lower("band") == "ndvi")
    now = scene_window_stats(keys.withColumn("band", F.lit("NDVI")), ndvi.withColumn("band", F.lit("NDVI")), cfg.modis_days, cfg.pick, ("mean",))
    current = now.select(*KEYS, F.year("date").alias("year"), F.col("mean").alias("current"))
    extremes = year_extremes(ndvi.withColumn("year", F.year("obs_date")), [*PLACE, "year", "px_row", "px_col"])
    vci = vci_by_region(extremes, current, [*PLACE, "year"])
    return vci.select(*KEYS, F.lit("VCI").alias("variable"), F.col("VCI").alias("mean"))
