"""Unit conversion of reanalysis statistics and the irrigation estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlake.config import ReanalysisConfig


def convert_units(variable: str, value: Column, cfg: ReanalysisConfig = ReanalysisConfig()) -> Column:
    """Metres to millimetres, kelvin to degrees C; other variables unchanged."""
    if "total_precipitation" in variable:
        return F.bround(value * F.lit(cfg.precipitation_factor), 3)
    if "potential_evaporation" in variable:
        return F.bround(value * F.lit(cfg.evaporation_factor), 3)
    if "temperature" in variable and not variable.endswith("stdDev"):
        return F.bround(value - F.lit(cfg.kelvin_offset), 2)
    return value


def irrigation_mm(evaporation_m: Column, precipitation_m: Column) -> Column:
    """Water deficit in mm from unconverted metres; null unless both are known."""
    deficit = -(evaporation_m + precipitation_m) * F.lit(1000.0)
    return F.when(deficit.isNotNull(), F.bround(F.greatest(F.lit(0.0), deficit), 3))
