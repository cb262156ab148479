"""Routing of plan rows to sources and the set of bands each key asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import OpticalConfig, RadarConfig, SoilConfig, TerrainConfig
from fieldlake.functions import text as T
from fieldlake.functions.weather import DERIVED
from fieldlake.naming import KEYS, col, dataset_column

# Patterns looked for in the lower-case dataset text.
SOURCE_PATTERNS = {
    "weather": "nasa",
    "optical": "modis|copernicus/s2|sentinel-2",
    "radar": "copernicus/s1|sentinel-1|sentinel1|s1_grd|s1|sar|radar|c-band",
    "terrain": "srtm",
    "reanalysis": "era5",
    "soil": "soilgrids|isric",
}
# The radar source also takes rows whose variable matches this.
RADAR_VARIABLE_PATTERN = "s1|sentinel.?1|radar|sar|vv|vh"


def source_flags(plan: DataFrame) -> dict[str, Column]:
    """Source -> condition on a plan row; conditions may overlap."""
    text = F.lower(T.trimmed(col(dataset_column(plan.columns))))
    flags = {name: F.coalesce(text.rlike(pattern), F.lit(False)) for name, pattern in SOURCE_PATTERNS.items()}
    if "variable" in plan.columns:
        named = F.coalesce(F.lower(col("variable")).rlike(RADAR_VARIABLE_PATTERN), F.lit(False))
        flags["radar"] = flags["radar"] | named
    return flags


def route_sources(plan: DataFrame) -> DataFrame:
    """One row per plan row and matching source."""
    hits = F.array(*(F.when(flag, F.lit(name)) for name, flag in source_flags(plan).items()))
    return plan.withColumn("source", F.explode(F.array_compact(hits)))


def source_rows(plan: DataFrame, source: str) -> DataFrame:
    return plan.filter(source_flags(plan)[source])


def plan_audit(plan: DataFrame) -> DataFrame:
    """Per source (and for unmatched rows): row count, overlaps and the dataset texts seen."""
    texts = [dataset_column(plan.columns), *(["variable"] if "variable" in plan.columns else [])]
    # Equal texts collapse before the shuffle, so each pattern runs once per distinct text.
    seen = plan.groupBy(*map(col, texts)).agg(F.count("*").alias("_n"))
    hits = F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in source_flags(seen).items())))
    tagged = seen.select(F.lower(T.trimmed(col(texts[0]))).alias("_text"), "_n", hits.alias("_hits"))
    rows = tagged.select(
        "_text", "_n", (F.size("_hits") > 1).alias("_shared"),
        F.explode(F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.array(F.lit("unmatched")))).alias("source"),
    )
    return rows.groupBy("source").agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("_shared"), F.col("_n")).otherwise(F.lit(0))).alias("n_shared"),
        F.array_sort(F.collect_set("_text")).alias("datasets"),
    )


def work_list(plan: DataFrame, source: str) -> DataFrame:
    """Distinct (date, latitude, longitude) a source has to serve."""
    return source_rows(plan, source).select(*KEYS).distinct()


def _union_sets(name: str) -> Column:
    """Distinct elements of an array column over the group, merged before the shuffle."""
    return F.array_distinct(F.flatten(F.collect_set(col(name))))


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _mapped(tokens: Column, rule) -> Column:
    return F.array_compact(F.transform(tokens, rule))


def weather_requests(plan: DataFrame) -> DataFrame:
    """Per key: parameters to read (named ones and inputs of derived ones) and derived variables."""
    variable = T.weather_var_key(col("variable"))
    derived = F.when(variable.isin(*DERIVED), F.array(variable)).otherwise(F.array().cast("array<string>"))
    inputs = reduce(
        lambda rule, item: rule.when(variable == item[0], F.array(*map(F.lit, item[1][0]))),
        DERIVED.items(),
        F.when(F.lit(False), F.array().cast("array<string>")),
    ).otherwise(F.array().cast("array<string>"))
    rows = plan.select(
        *KEYS, derived.alias("_d"), F.array_union(T.param_tokens(col("api parameter")), inputs).alias("_p")
    )
    out = rows.groupBy(*KEYS).agg(
        F.array_sort(_union_sets("_p")).alias("params"), F.array_sort(_union_sets("_d")).alias("derived")
    )
    return out.filter(F.size("params") > 0)


def optical_requests(plan: DataFrame, cfg: OpticalConfig = OpticalConfig()) -> DataFrame:
    """Per key: raw bands (short names first) and indexes in their fixed order."""
    api, variable = F.coalesce(col("api parameter"), F.lit("")), F.coalesce(col("variable"), F.lit(""))
    tokens = F.concat(T.split_list(api), T.split_list(variable))
    rows = plan.select(
        *KEYS,
        F.filter(tokens, T.is_raw_band).alias("_raw"),
        _mapped(tokens, lambda t: F.when(~T.is_raw_band(t), T.optical_token(t))).alias("_der"),
        F.lower(api).contains("derived").alias("_all"),
    )
    grouped = rows.groupBy(*KEYS).agg(
        _union_sets("_raw").alias("_raw"), _union_sets("_der").alias("_der"), _any(F.col("_all")).alias("_all")
    )
    everything = F.array(*map(F.lit, cfg.derived))
    chosen = F.when(F.col("_all") & (F.size("_der") == 0), everything).otherwise(F.col("_der"))
    by_length = F.array_sort(F.transform("_raw", lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))
    return grouped.select(
        *KEYS,
        F.transform(by_length, lambda s: s["b"]).alias("raw"),
        F.filter(everything, lambda b: F.array_contains(chosen, b)).alias("derived"),
    )


def wants_vci(plan: DataFrame) -> DataFrame:
    """Per key: whether the vegetation condition index is asked for."""
    api, variable = F.coalesce(col("api parameter"), F.lit("")), F.lower(F.coalesce(col("variable"), F.lit("")))
    by_name = T.is_derived(api) & (variable.contains("vci") | variable.contains("vegetation condition"))
    by_token = F.exists(T.split_list(api), lambda t: F.lower(t) == "vci")
    return plan.groupBy(*KEYS).agg(_any(by_name | by_token).alias("wants_vci"))


def _chosen_by_derived(plan: DataFrame, splitter, rule) -> DataFrame:
    """Per key: tokens of the variable column, tokens of the api column, and whether any row says 'derived'."""
    rows = plan.select(
        *KEYS,
        _mapped(splitter(col("variable")), rule).alias("_var"),
        _mapped(splitter(col("api parameter")), rule).alias("_api"),
        T.is_derived(col("api parameter")).alias("_flag"),
    )
    return rows.groupBy(*KEYS).agg(
        _union_sets("_var").alias("by_variable"), _union_sets("_api").alias("by_api"), _any(F.col("_flag")).alias("derived")
    )


def sar_requests(plan: DataFrame, cfg: RadarConfig = RadarConfig()) -> DataFrame:
    """Per key: the radar groups wanted, sorted."""
    sets = _chosen_by_derived(plan, T.split_list_sar, T.sar_token)
    by_variable, by_api = F.col("by_variable"), F.col("by_api")
    base, default = F.array(*map(F.lit, cfg.polarisations)), F.array(*map(F.lit, cfg.default_groups))
    groups = (
        F.when(F.col("derived") & (F.size(by_variable) > 0), F.array_union(by_variable, base))
        .when(F.col("derived"), default)
        .when(F.size(by_api) > 0, by_api)
        .when(F.size(by_variable) > 0, by_variable)
        .otherwise(default)
    )
    return sets.select(*KEYS, F.array_sort(groups).alias("groups"))


def sar_stat_keys(requests: DataFrame, cfg: RadarConfig = RadarConfig()) -> DataFrame:
    """Add the bands to read and the output column names of each key's groups."""
    groups = F.col("groups")
    needs_both = F.arrays_overlap(groups, F.array(F.lit("VVVH_ratio"), F.lit("RVI")))
    base = F.array(*map(F.lit, cfg.polarisations))
    bands = F.when(needs_both, base).otherwise(F.array_intersect(base, groups))
    suffixes = F.array(*(F.lit(f"__{s}") for s in cfg.statistics))
    keys = F.flatten(F.transform(groups, lambda g: F.transform(suffixes, lambda s: F.concat(g, s))))
    return requests.withColumns({"bands": bands, "stat_keys": keys})


def terrain_requests(plan: DataFrame, cfg: TerrainConfig = TerrainConfig()) -> DataFrame:
    """Per key: terrain bands, in their fixed order; all of them when none is named."""
    sets = _chosen_by_derived(plan, T.split_list, T.terrain_token)
    named = F.when(F.col("derived"), F.col("by_variable")).otherwise(F.col("by_api"))
    everything = F.array(*map(F.lit, cfg.bands))
    bands = F.when(F.size(named) > 0, F.filter(everything, lambda b: F.array_contains(named, b))).otherwise(everything)
    return sets.select(*KEYS, bands.alias("bands"))


def reanalysis_requests(plan: DataFrame) -> DataFrame:
    """Per key: reanalysis bands and whether the irrigation estimate is wanted; keys without bands are left out."""
    api = T.trimmed(F.coalesce(col("api parameter"), F.lit("")))
    named = (api != "") & (F.lower(api) != "derived")
    irrigation = ~named & (F.lower(T.trimmed(F.coalesce(col("variable"), F.lit("")))) == "irrigation")
    bands = (
        F.when(named, F.transform(T.split_list(api), T.reanalysis_token))
        .when(irrigation, F.array(F.lit("total_precipitation"), F.lit("potential_evaporation")))
        .otherwise(F.array().cast("array<string>"))
    )
    rows = plan.select(*KEYS, bands.alias("_b"), irrigation.alias("_i"))
    out = rows.groupBy(*KEYS).agg(F.array_sort(_union_sets("_b")).alias("bands"), _any(F.col("_i")).alias("irrigation"))
    return out.filter(F.size("bands") > 0)


def soil_requests(plan: DataFrame, cfg: SoilConfig = SoilConfig()) -> DataFrame:
    """Per key and soil property: the bands wanted; tokens of unknown properties are dropped."""
    tokens = plan.select(*KEYS, F.explode(F.transform(T.split_list(col("api parameter")), T.soil_token)).alias("band"))
    known = tokens.withColumn("prefix", F.split_part("band", F.lit("_"), F.lit(1))).filter(
        F.col("band").contains("_") & F.col("prefix").isin(*cfg.prefixes)
    )
    return known.groupBy(*KEYS, "prefix").agg(F.array_sort(F.collect_set("band")).alias("bands"))


def match_bands(requests: DataFrame, bands: DataFrame, token: str = "token") -> DataFrame:
    """Requested tokens that name an existing band in any case; the requested spelling stays."""
    folded = bands.select(col("band"), F.lower("band").alias("_fold"))
    return requests.withColumn("_fold", F.lower(col(token))).join(folded, "_fold").drop("_fold")
