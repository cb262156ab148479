"""Formulas, row by row over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import raster as R
from fieldlake.functions import units as U
from fieldlake.functions.features import doy_sin, engineer_features
from fieldlake.functions.weather import add_derived
from fieldlake.queries.base import Tables, query

_WEATHER = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 10 AS tmean, l_quantity - 5 + l_tax * 100 AS tmax,
  l_quantity - 15 AS tmin, l_discount * 900 + CASE WHEN l_linenumber = 7 THEN 0 ELSE 5 END AS rh FROM lineitem"""


@query("derived_weather", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(tmax - tmin, 6) AS dtr, round(237.7 * g / (17.27 - g), 6) AS dew_point,
       round(0.6108 * exp(17.27 * tmean / (tmean + 237.3)) * (1 - rh / 100), 6) AS vpd
FROM (SELECT *, 17.27 * tmean / (237.7 + tmean) + CASE WHEN rh > 0 THEN ln(rh / 100) END AS g FROM ({_WEATHER}))""")
def derived_weather(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    base = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (q - 10).alias("T2M"), (q - 5 + F.col("l_tax") * 100).alias("T2M_MAX"), (q - 15).alias("T2M_MIN"),
        (F.col("l_discount") * 900 + F.when(F.col("l_linenumber") == 7, 0).otherwise(5)).alias("RH2M"),
    )
    out = add_derived(base)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("DTR", 6).alias("dtr"), F.round("DEW POINT TEMPERATURE", 6).alias("dew_point"), F.round("VPD", 6).alias("vpd")
    )


@query("clear_sky_pixels", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE CAST(l_quantity AS INT) % 12 NOT IN (3, 6, 8, 9, 10, 11)")
def clear_sky_pixels(t: Tables) -> DataFrame:
    scene_class = F.col("l_quantity").cast("int") % 12
    return t("lineitem").filter(R.scl_clear(scene_class)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("vegetation_indexes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((n - r) / (n + r), 7) AS ndvi, round(2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1), 7) AS evi,
  round(3.618 * ((n - r) / (n + r)) - 0.118, 7) AS lai, round(1.5 * (n - r) / (n + r + 0.5), 7) AS savi, round((n - e) / (n + e), 7) AS ndre, round(n / e - 1, 7) AS cire
FROM (SELECT *, (l_tax * 1000 + 200) / 10000 AS b, (l_discount * 1000 + 300) / 10000 AS r, (l_quantity * 20 + 800) / 10000 AS e, (l_quantity * 41 + 1500) / 10000 AS n FROM lineitem)""")
def vegetation_indexes(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    made = R.optical_indexes(F.col("l_tax") * 1000 + 200, F.col("l_discount") * 1000 + 300, q * 20 + 800, q * 41 + 1500)
    names = {"NDVI": "ndvi", "EVI": "evi", "LAI": "lai", "SAVI": "savi", "NDRE": "ndre", "CIredge": "cire"}
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(v, 7).alias(names[k]) for k, v in made.items()))


@query("radar_ratios", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(vv, 7) AS vv_linear, round(vv / vh, 5) AS ratio, round(4 * vh / (vv + vh), 7) AS rvi
FROM (SELECT *, pow(10, (-5 - l_quantity / 10) / 10) AS vv, pow(10, (-12 - l_discount * 50) / 10) AS vh FROM lineitem)""")
def radar_ratios(t: Tables) -> DataFrame:
    vv, vh = F.lit(-5) - F.col("l_quantity") / 10, F.lit(-12) - F.col("l_discount") * 50
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(R.db_to_linear(vv), 7).alias("vv_linear"), F.round(R.vv_vh_ratio_linear(vv, vh), 5).alias("ratio"), F.round(R.rvi(vv, vh), 7).alias("rvi")
    )


@query("unit_conversions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_tax / 7 * 1000, 3) AS rain, CASE WHEN l_discount = 0 THEN 0 ELSE round_even(l_discount / 7 * -1000, 3) END AS evap, round_even(l_quantity * 7.001 - 273.15, 2) AS temp, l_tax AS soil
FROM lineitem""")
def unit_conversions(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.convert_units("total_precipitation__mean", F.col("l_tax") / 7).alias("rain"),
        U.convert_units("potential_evaporation__mean", F.col("l_discount") / 7).alias("evap"),
        U.convert_units("skin_temperature__mean", F.col("l_quantity") * 7.001).alias("temp"), U.convert_units("soil_water", F.col("l_tax")).alias("soil"),
    )


@query("irrigation_estimate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 3 THEN round_even(greatest(0, -(-l_discount / 7 + l_tax / 9) * 1000), 3) END AS irrigation_mm FROM lineitem""")
def irrigation_estimate(t: Tables) -> DataFrame:
    evaporation = F.when(F.col("l_linenumber") != 3, -F.col("l_discount") / 7)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", U.irrigation_mm(evaporation, F.col("l_tax") / 9).alias("irrigation_mm"))


@query("day_of_year_sine", "SELECT o_orderkey, round(sin(2 * pi() * dayofyear(o_orderdate) / 365), 9) AS doy_sin FROM orders")
def day_of_year_sine(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.round(doy_sin(F.col("o_orderdate")), 9).alias("doy_sin"))


_INPUTS = {
    "T2M__mean": "l_quantity - 10", "T2M_MAX__mean": "CASE WHEN l_linenumber <> 2 THEN l_quantity END", "T2M_MIN__mean": "CASE WHEN l_linenumber <> 3 THEN l_quantity - 20 END",
    "ET__mean": "l_tax * 10", "ALLSKY_SFC_SW_DWN__mean": "l_discount * 100", "VPD__mean": "l_discount * 7", "NDVI__max": "l_tax + 0.5", "NDVI__min": "l_tax / 2",
    "NDVI__mean": "l_tax", "EVI__max": "l_discount + 0.25", "EVI__min": "l_discount", "VV__mean": "-5 - l_quantity / 10", "VH__mean": "-12 - l_discount * 50",
    "VV__stdDev": "l_tax * 3", "elevation__mean": "l_quantity * 9", "sand_0-5cm_mean__mean": "l_discount * 300", "clay_0-5cm_mean__mean": "l_tax * 300",
}
_ROUNDED = ["GDD_base10", "ET_solar_ratio", "VPD_ET_interaction", "NDVI_amplitude", "greenness_persistence", "EVI_amplitude", "VV_VH_ratio", "VV_texture", "temp_elevation_interaction", "water_holding_capacity"]


@query("engineered_features", "WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f'{v} AS "{k}"' for k, v in _INPUTS.items()) + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, "T2M__mean" - 10), 5) AS "GDD_base10", coalesce("T2M_MAX__mean" >= 35, false)::INT AS heat_days_35, coalesce("T2M_MIN__mean" <= 15, false)::INT AS chill_nights_15,
  round("ET__mean" / ("ALLSKY_SFC_SW_DWN__mean" + 1e-6), 5) AS "ET_solar_ratio", round("VPD__mean" * "ET__mean", 5) AS "VPD_ET_interaction", round("NDVI__max" - "NDVI__min", 5) AS "NDVI_amplitude",
  round(("NDVI__mean" - "NDVI__min") / ("NDVI__max" - "NDVI__min" + 1e-6), 5) AS greenness_persistence, round("EVI__max" - "EVI__min", 5) AS "EVI_amplitude", round("VV__mean" / ("VH__mean" + 1e-6), 5) AS "VV_VH_ratio",
  round("VV__stdDev", 5) AS "VV_texture", round("T2M__mean" * "elevation__mean", 5) AS temp_elevation_interaction, round("clay_0-5cm_mean__mean" / ("sand_0-5cm_mean__mean" + 1e-6), 5) AS water_holding_capacity FROM i""")
def engineered_features(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    inputs = t("lineitem").select(*keys, *(F.expr(v.replace("0.25", "0.25D").replace("0.5", "0.5D")).alias(k) for k, v in _INPUTS.items()))
    out = engineer_features(inputs)
    return out.select(*keys, "heat_days_35", "chill_nights_15", *(F.round(c, 5).alias(c) for c in _ROUNDED))
