"""Scene catalogues and pixel tables.

scenes: product, scene_id, scene_ts, cloud_pct, instrument_mode, polarisations, resolution_m
pixels: product, scene_id, band, px_row, px_col, lat, lon, value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import OpticalConfig, RadarConfig
from fieldlake.operators.joins import with_cell
from fieldlake.session import may_broadcast, salted_join


def scene_predicate(product: str, optical: OpticalConfig = OpticalConfig(), radar: RadarConfig = RadarConfig()) -> Column:
    """Metadata conditions of a product; products without any are taken whole."""
    rule = F.col("product") == product
    if product == "S2":
        return rule & (F.col("cloud_pct") < optical.max_cloud_pct)
    if product == "S1":
        rule = rule & (F.col("instrument_mode") == radar.instrument_mode)
        rule = rule & (F.col("resolution_m") == radar.resolution_m)
        for polarisation in radar.polarisations:
            rule = rule & F.array_contains("polarisations", polarisation)
    return rule


def select_scenes(
    scenes: DataFrame, product: str, optical: OpticalConfig = OpticalConfig(), radar: RadarConfig = RadarConfig()
) -> DataFrame:
    """Usable scenes of a product; the plain comparisons reach the file scan."""
    return scenes.filter(scene_predicate(product, optical, radar))


def scene_pixels(scenes: DataFrame, pixels: DataFrame, bands: list[str] | None = None, salts: int = 8) -> DataFrame:
    """Pixels of the given scenes with the scene time.

    A scene list of checked size is broadcast, so pixels stay where they are; a larger one meets them by a salted join,
    because one scene may hold a large share of the pixels.
    """
    wanted = pixels.filter(F.col("band").isin(*bands)) if bands else pixels
    listed, keys = scenes.select("product", "scene_id", "scene_ts"), ["product", "scene_id"]
    if may_broadcast(listed):
        return wanted.join(F.broadcast(listed), keys)
    return salted_join(wanted, listed, keys, salts=salts)


def write_pixels(pixels: DataFrame, path: str, buffer_m: float) -> None:
    """Store pixels clustered by cell, so that the boxes round places skip files and row groups.

    Ranges end inside a cell where one holds many pixels; adaptive execution sizes the files.
    """
    placed = with_cell(pixels, buffer_m)
    order = ["_clat", "_clon", "lat", "lon"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_clat", "_clon").write.mode("overwrite").parquet(path)


def available_bands(pixels: DataFrame) -> DataFrame:
    """(product, band) pairs present; partial aggregation keeps the shuffle small."""
    return pixels.select("product", "band").distinct()


def resolve_bands(requests: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (product, band) requests into those available and those to report as dropped."""
    kept = requests.join(bands, ["product", "band"], "left_semi")
    dropped = requests.join(bands, ["product", "band"], "left_anti")
    return kept, dropped
