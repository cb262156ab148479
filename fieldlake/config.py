"""Settings. All values here are fixed values that define the results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class WeatherConfig:
    window_days: int = 15
    missing_value: float = -999.0
    lat_bounds: tuple[float, float] = (-90.0, 90.0)
    lon_bounds: tuple[float, float] = (-180.0, 180.0)


@dataclass(frozen=True)
class OpticalConfig:
    buffer_m: float = 500.0
    max_cloud_pct: float = 20.0
    s2_days: int = 7
    modis_days: int = 16
    modis_et_days: int = 8
    derived: tuple[str, ...] = ("NDVI", "EVI", "LAI", "SAVI", "NDRE", "CIredge")
    omit_zero_mean: bool = True
    pick: str = "earliest"  # or "nearest"


@dataclass(frozen=True)
class RadarConfig:
    buffer_m: float = 450.0
    window_days: int = 25
    mode: str = "window_median"  # or "nearest"
    instrument_mode: str = "IW"
    resolution_m: int = 10
    pixel_m: float = 10.0  # pixel pitch, for the rim the speckle filter needs
    polarisations: tuple[str, ...] = ("VV", "VH")
    default_groups: tuple[str, ...] = ("VV", "VH", "VVVH_ratio", "RVI")
    statistics: tuple[str, ...] = ("mean", "stdDev", "min", "max")


@dataclass(frozen=True)
class TerrainConfig:
    buffer_m: float = 600.0
    bands: tuple[str, ...] = ("elevation", "slope", "aspect", "hillshade")
    excluded_stats: tuple[str, ...] = ("aspect__min",)


@dataclass(frozen=True)
class ReanalysisConfig:
    buffer_m: float = 600.0
    sum_bands: tuple[str, ...] = ("total_precipitation", "potential_evaporation")
    precipitation_factor: float = 1000.0
    evaporation_factor: float = -1000.0
    kelvin_offset: float = 273.15
    # After the sign flip the smallest converted value is the old maximum.
    # False swaps the two names so that min <= max; True keeps the raw names.
    keep_flipped_extremes: bool = False


@dataclass(frozen=True)
class SoilConfig:
    buffer_m: float = 600.0
    prefixes: tuple[str, ...] = ("ocd", "phh2o", "sand", "silt", "clay", "nitrogen", "cec", "cfvo", "bdod")
    default_bands: tuple[str, ...] = (
        "bdod_0-5cm_mean", "clay_0-5cm_mean", "sand_0-5cm_mean", "silt_0-5cm_mean", "ocd_0-5cm_mean",
        "phh2o_0-5cm_mean", "nitrogen_0-5cm_mean", "cec_0-5cm_mean", "cfvo_0-5cm_mean",
    )


@dataclass(frozen=True)
class MasterConfig:
    include_mapping_columns: bool = False
    priority_columns: tuple[str, ...] = (
        "fp_Harvest Date", "fp_Area", "fp_Latitude", "fp_Longitude",
        "fp_Season", "fp_Intensity", "fp_Harvest Area", "fp_yield (kg / ha)",
    )


@dataclass(frozen=True)
class ModelConfig:
    target: str = "fp_yield (kg / ha)"
    category_columns: tuple[str, ...] = ("fp_Area", "fp_Season", "fp_Intensity")
    group_columns: tuple[str, ...] = ("fp_Area", "fp_Season")
    season_column: str = "fp_Season"
    folds: int = 5
    seed: int = 10000291
    features: int = 15
    missing_threshold: float = 0.2
    svm_floor: float = 0.05
    extra_drops: tuple[str, ...] = field(default=("latitude", "longitude", "slope__min"))


# Name parts that put a column into a family. A column may be in several.
FAMILIES: dict[str, tuple[str, ...]] = {
    "Meteorology": ("T2M", "RH2M", "VPD", "WS2M", "ALLSKY", "DTR", "DEW", "ET"),
    "Vegetation": ("NDVI", "EVI", "LAI", "NDRE", "SAVI", "CIREDGE", "GPP", "FPAR"),
    "SAR": ("VV", "VH", "RVI"),
    "Soil": ("ocd_", "nitrogen_", "phh2o_", "sand_", "silt_", "clay_", "bdod_"),
    "Topography": ("elevation", "slope", "aspect"),
    "Climate": ("precipitation", "evaporation", "temperature", "soil_water"),
}
VEGETATION_INDEXES = ("NDVI", "EVI", "LAI", "NDRE", "SAVI", "CIREDGE")
TERRAIN_NAMES = ("elevation", "slope", "aspect", "hillshade")


def in_family(column: str, family: str) -> bool:
    """Family test on the name, ignoring case."""
    lowered = column.lower()
    return any(part.lower() in lowered for part in FAMILIES[family])


def families_of(columns: list[str]) -> dict[str, list[str]]:
    """Family -> its columns, in column order; families without columns are left out."""
    found = {name: [c for c in columns if in_family(c, name)] for name in FAMILIES}
    return {name: members for name, members in found.items() if members}
