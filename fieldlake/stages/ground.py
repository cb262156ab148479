"""Terrain, reanalysis and soil statistics per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ReanalysisConfig, SoilConfig, TerrainConfig
from fieldlake.functions.units import convert_units, irrigation_mm
from fieldlake.naming import KEYS, col, stat_name
from fieldlake.operators.grids import terrain
from fieldlake.operators.zonal import daily_reduce, pivot_stats, suppress_zero, zonal_stats
from fieldlake.plans.requests import reanalysis_requests, soil_requests, source_rows, terrain_requests
from fieldlake.session import cut_lineage, shuffled
from fieldlake.stages.common import PLACE, near_pixels, region_pixels, requested_values

TERRAIN_STATS = ("mean", "stdDev", "min", "max")
PLAIN_STATS = ("mean", "min", "max")


def terrain_stage(plan: DataFrame, dem: DataFrame, cell_m: float, cfg: TerrainConfig = TerrainConfig()) -> DataFrame:
    """``dem`` is (px_row, px_col, lat, lon, value). Statistics are per place; dates only repeat them."""
    requests = cut_lineage(terrain_requests(source_rows(plan, "terrain"), cfg))
    near = near_pixels(requests, dem.select("px_row", "px_col", "lat", "lon", "value"), cfg.buffer_m + 3.0 * cell_m)
    layers = terrain(near, cell_m).unpivot(["px_row", "px_col"], list(cfg.bands), "variable", "value")
    spots = near.select("px_row", "px_col", "lat", "lon").join(layers, ["px_row", "px_col"])
    stats = zonal_stats(region_pixels(requests, spots, cfg.buffer_m), [*PLACE, "variable"], TERRAIN_STATS)
    asked = requests.select(*KEYS, F.explode("bands").alias("variable"))
    kept = suppress_zero(shuffled(asked).join(stats, [*PLACE, "variable"]), "terrain")
    wide = pivot_stats(kept, KEYS, list(cfg.bands), list(TERRAIN_STATS))
    return wide.drop(*cfg.excluded_stats)


def reanalysis_stage(plan: DataFrame, hourly: DataFrame, cfg: ReanalysisConfig = ReanalysisConfig()) -> DataFrame:
    """``hourly`` is (ts, band, px_row, px_col, lat, lon, value): daily totals or means, then region statistics.

    Bands the data does not have simply find no rows. Irrigation uses the
    unconverted means; units are converted last.
    """
    requests = cut_lineage(reanalysis_requests(source_rows(plan, "reanalysis")))
    bands = requested_values(requests, "bands")
    first, last = requests.agg(F.min("date"), F.max("date")).first()
    days = (F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(last), 1).cast("timestamp"))
    slim = hourly.filter(F.col("band").isin(*bands) & days).withColumn("date", F.to_date("ts"))
    region = region_pixels(requests, slim, cfg.buffer_m)
    asked = requests.select(*KEYS, "irrigation", F.explode("bands").alias("band"))
    # Only days that some key asks for are reduced.
    needed = region.join(shuffled(asked.select(*KEYS, "band").distinct()), [*KEYS, "band"], "left_semi")
    daily = daily_reduce(needed, [*KEYS, "band", "px_row", "px_col"], cfg.sum_bands)
    stats = zonal_stats(daily, [*KEYS, "band"], PLAIN_STATS).withColumnRenamed("band", "variable")
    wide = pivot_stats(stats, KEYS, bands, list(PLAIN_STATS))
    flags = requests.select(*KEYS, "irrigation")
    both = shuffled(flags).join(wide, KEYS)
    made = {}
    for band in bands:
        flipped = "potential_evaporation" in band and not cfg.keep_flipped_extremes
        for s in PLAIN_STATS:
            source = {"min": "max", "max": "min"}.get(s, s) if flipped else s
            made[stat_name(band, s)] = convert_units(band, col(stat_name(band, source)), cfg)
    columns = [made[n].alias(n) for n in made]
    if {"total_precipitation", "potential_evaporation"} <= set(bands):
        water = irrigation_mm(col("potential_evaporation__mean"), col("total_precipitation__mean"))
        columns.append(F.when(F.col("irrigation"), water).alias("irrigation_mm"))
    return both.select(*KEYS, *columns)


def soil_stage(plan: DataFrame, pixels: DataFrame, cfg: SoilConfig = SoilConfig()) -> DataFrame:
    """``pixels`` is (band, px_row, px_col, lat, lon, value). Static: statistics per place, repeated per date."""
    requests = cut_lineage(soil_requests(source_rows(plan, "soil"), cfg))
    bands = requested_values(requests, "bands")
    region = region_pixels(requests, pixels.filter(F.col("band").isin(*bands)), cfg.buffer_m)
    stats = zonal_stats(region, [*PLACE, "band"], PLAIN_STATS)
    asked = requests.select(*KEYS, F.explode("bands").alias("band"))
    return pivot_stats(shuffled(asked).join(stats, [*PLACE, "band"]).withColumnRenamed("band", "variable"), KEYS, bands, list(PLAIN_STATS))
