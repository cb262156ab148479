"""Whole stages: requests joined to landed data, aggregated, one row per key."""

from fieldlake.stages.ground import reanalysis_stage, soil_stage, terrain_stage
from fieldlake.stages.master import field_meta, run_all
from fieldlake.stages.model import run_model
from fieldlake.stages.optical import optical_stage
from fieldlake.stages.radar import radar_stage
from fieldlake.stages.weather import weather_stage

__all__ = [
    "field_meta", "optical_stage", "radar_stage", "reanalysis_stage", "run_all", "run_model", "soil_stage",
    "terrain_stage", "weather_stage",
]
