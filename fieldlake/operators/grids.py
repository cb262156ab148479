"""Neighbourhood operators on regular grids: speckle filter and terrain.

No raster, row or column is ever ordered in one task: the median works on tiles
of fixed size, the terrain on an aggregate of shifted copies that shrinks
before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.naming import col

# Sun position of the shaded relief.
SUN_AZIMUTH_DEG = 270.0
SUN_ELEVATION_DEG = 45.0


def _offsets(radius: int) -> Column:
    steps = range(-radius, radius + 1)
    pairs = [F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in steps for c in steps]
    return F.array(*pairs)


def shifted(grid: DataFrame, value: str, by: list[str], radius: int = 1) -> DataFrame:
    """Each value offered to every pixel of its neighbourhood, with the place it holds there."""
    spread = grid.select(*map(col, by), "px_row", "px_col", col(value).alias("_v"), F.explode(_offsets(radius)).alias("_o"))
    return spread.select(
        *map(col, by),
        (F.col("px_row") - F.col("_o.dr")).alias("px_row"),
        (F.col("px_col") - F.col("_o.dc")).alias("px_col"),
        F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"), "_v",
    )


def _median_of_tile(value: str, radius: int):
    """Grouped function: one tile (with its rim) to the medians of the tile's own pixels."""

    def smooth(tile: pd.DataFrame) -> pd.DataFrame:
        rows = (tile["px_row"] - tile["px_row"].min()).to_numpy() + radius
        cols = (tile["px_col"] - tile["px_col"].min()).to_numpy() + radius
        grid = np.full((rows.max() + radius + 1, cols.max() + radius + 1), np.nan)
        grid[rows, cols] = tile[value].to_numpy(dtype=float)
        own = tile["_own"].to_numpy()
        out = tile[own].drop(columns=["_own", "_trow", "_tcol"])
        steps = range(-radius, radius + 1)
        near = np.stack([grid[rows[own] + dr, cols[own] + dc] for dr in steps for dc in steps])
        known = ~np.isnan(near).all(axis=0)
        median = np.full(near.shape[1], np.nan)
        median[known] = np.nanmedian(near[:, known], axis=0)
        return out.assign(**{value: median})

    return smooth


def focal_median(
    pixels: DataFrame, by: list[str], value: str = "value", radius: int = 1, tile: int = 256, carry: list[str] | None = None
) -> DataFrame:
    """Median of the square neighbourhood of every pixel; ``by`` names the raster (scene, band).

    ``carry`` columns of the pixel pass through unchanged.

    The raster (one row per pixel) is cut into tiles of fixed size. Only rim
    pixels are copied to the next tile, so the shuffle carries each pixel about
    once, and no group exceeds (tile + 2 radius) squared rows.
    """
    def reach(name: str) -> Column:
        spots = F.array(*(F.floor((col(name) + d) / F.lit(tile)) for d in (-radius, 0, radius)))
        return F.explode(F.array_distinct(spots))

    base = pixels.select(*map(col, by), "px_row", "px_col", *map(col, carry or []), col(value).cast("double").alias(value))
    spread = base.withColumn("_trow", reach("px_row")).withColumn("_tcol", reach("px_col"))
    own = (F.col("_trow") == F.floor(F.col("px_row") / F.lit(tile))) & (
        F.col("_tcol") == F.floor(F.col("px_col") / F.lit(tile))
    )
    tiles = spread.withColumn("_own", own).groupBy(*map(col, by), "_trow", "_tcol")
    smooth = tiles.applyInPandas(_median_of_tile(value, radius), base.schema)
    return smooth.withColumn(value, F.when(~F.isnan(col(value)), col(value)))


def terrain(dem: DataFrame, cell_m: float, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Slope, aspect (degrees) and hillshade (0-255) from elevation by central differences.

    Rows run south to north and columns west to east, ``cell_m`` apart. Pixels
    on the edge have no full neighbourhood and give null.
    """
    by = by or []

    def at(dr: int, dc: int) -> Column:
        return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("_v").cast("double")))

    cross = shifted(dem, value, by).filter((F.col("dr") == 0) | (F.col("dc") == 0))
    near = cross.groupBy(*map(col, by), "px_row", "px_col").agg(
        at(0, 0).alias("elevation"), at(1, 0).alias("_n"), at(-1, 0).alias("_s"), at(0, 1).alias("_e"), at(0, -1).alias("_w")
    )
    dzdx = (F.col("_e") - F.col("_w")) / F.lit(2.0 * cell_m)
    dzdy = (F.col("_n") - F.col("_s")) / F.lit(2.0 * cell_m)
    steep = F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy))
    # Compass direction the surface faces: downhill, clockwise from north.
    facing = F.atan2(-dzdx, -dzdy)
    zenith, azimuth = F.radians(F.lit(90.0 - SUN_ELEVATION_DEG)), F.radians(F.lit(SUN_AZIMUTH_DEG))
    light = F.cos(zenith) * F.cos(steep) + F.sin(zenith) * F.sin(steep) * F.cos(azimuth - facing)
    return near.filter(F.col("elevation").isNotNull()).select(
        *map(col, by), "px_row", "px_col", "elevation",
        F.degrees(steep).alias("slope"),
        F.when(steep == 0, F.lit(0.0)).otherwise(F.pmod(F.degrees(facing) + 360.0, F.lit(360.0))).alias("aspect"),
        (F.lit(255.0) * F.greatest(light, F.lit(0.0))).alias("_shade"),
    ).select("*", F.when(F.col("slope").isNotNull(), F.col("_shade")).alias("hillshade")).drop("_shade")
