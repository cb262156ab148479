import math

import pytest
from pyspark.sql import functions as F

from fieldlake.functions import raster as R
from fieldlake.functions import text as T
from fieldlake.functions import units as U
from fieldlake.functions import weather as W
from fieldlake.functions.features import ENGINEERED, engineer_features, flag, gdd_base10


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, days", [
    ("static", 0), ("Once", 0), ("N/A", 0), ("none", None), (None, None), ("", None), ("daily", 1), ("Daily/Seasonal", 1), ("weekly", 7),
    ("5 to 10 days", 8), ("5-8", 6), ("1 – 2", 2), ("~16 days", 16), ("8d", 8), ("12", 12), ("every 3", None), ("monthly", None),
])
def test_frequency_forms(spark, text, days):
    assert one(spark, T.clean_frequency(F.lit(text).cast("string"))) == days


def test_clean_text_trims_before_replacing(spark):
    assert one(spark, T.clean_text(F.lit("  a\nb\tc ‘x’ – y\r\n"))) == "a b c 'x' - y"
    assert one(spark, T.clean_text(F.lit("—\n—"))) == "- -"


@pytest.mark.parametrize("token, group", [
    ("VV/VH ratio", "VVVH_ratio"), ("S1 VV/VH ratio  linear", "VVVH_ratio"), ("vv over vh", "VVVH_ratio"), ("VV_mean", "VV"), ("vh-max", "VH"),
    ("RVI", "RVI"), ("Radar Vegetation Index", "RVI"), ("vvvh", None), ("height", None), ("", None),
])
def test_radar_tokens(spark, token, group):
    assert one(spark, T.sar_token(F.lit(token))) == group


@pytest.mark.parametrize("token, band", [
    ("Elevation_mean", "elevation"), ("elev", "elevation"), ("hill shade", "hillshade"), ("slope_stdDev", "slope"), ("aspect_min", "aspect"), ("height", None),
])
def test_terrain_tokens(spark, token, band):
    assert one(spark, T.terrain_token(F.lit(token))) == band


def test_list_splitters(spark):
    assert one(spark, T.split_list(F.lit("a/b | (c); ,d"))) == ["a", "b", "c", "d"]
    assert one(spark, T.split_list_sar(F.lit("VV/VH (x); RVI"))) == ["VV/VH  x", "RVI"]
    assert one(spark, T.split_list(F.lit(None).cast("string"))) == []
    assert one(spark, T.param_tokens(F.lit("t2m, Derived; ;rh2m"))) == ["T2M", "RH2M"]


def test_weather_formulas(spark):
    t, rh = 25.0, 60.0
    gamma = 17.27 * t / (237.7 + t) + math.log(rh / 100)
    assert one(spark, W.dew_point(F.lit(t), F.lit(rh))) == pytest.approx(237.7 * gamma / (17.27 - gamma))
    assert one(spark, W.vpd(F.lit(t), F.lit(rh))) == pytest.approx(0.6108 * math.exp(17.27 * t / (t + 237.3)) * 0.4)
    assert one(spark, W.dew_point(F.lit(t), F.lit(0.0))) is None


def test_derived_needs_all_inputs(spark):
    frame = spark.createDataFrame([(30.0, 10.0)], "T2M_MAX double, T2M_MIN double")
    assert W.add_derived(frame).columns == ["T2M_MAX", "T2M_MIN", "DTR"]


def test_optical_formulas(spark):
    row = spark.range(1).select(*(v.alias(k) for k, v in R.optical_indexes(F.lit(500), F.lit(1000), F.lit(2000), F.lit(4000)).items())).first()
    assert row["NDVI"] == pytest.approx(0.6)
    assert row["EVI"] == pytest.approx(2.5 * 0.3 / (0.4 + 0.6 - 0.375 + 1))
    assert row["LAI"] == pytest.approx(3.618 * 0.6 - 0.118)
    assert row["SAVI"] == pytest.approx(1.5 * 0.3 / 1.0)
    assert row["NDRE"] == pytest.approx(0.2 / 0.6)
    assert row["CIredge"] == pytest.approx(1.0)


def test_radar_formulas(spark):
    assert one(spark, R.vv_vh_ratio_linear(F.lit(-10.0), F.lit(-20.0))) == pytest.approx(10.0)
    assert one(spark, R.rvi(F.lit(-10.0), F.lit(-20.0))) == pytest.approx(0.04 / 0.11)


def test_units_round_half_even_and_irrigation_guards(spark):
    assert one(spark, U.convert_units("total_precipitation__mean", F.lit(0.0021))) == pytest.approx(2.1)
    assert one(spark, U.convert_units("potential_evaporation__min", F.lit(-0.002))) == pytest.approx(2.0)
    assert one(spark, U.convert_units("skin_temperature__mean", F.lit(300.0))) == pytest.approx(26.85)
    assert one(spark, U.irrigation_mm(F.lit(-0.005), F.lit(0.002))) == pytest.approx(3.0)
    assert one(spark, U.irrigation_mm(F.lit(-0.001), F.lit(0.002))) == 0.0
    assert one(spark, U.irrigation_mm(F.lit(None).cast("double"), F.lit(0.002))) is None


def test_null_guards_of_features(spark):
    assert one(spark, gdd_base10(F.lit(None).cast("double"))) is None
    assert one(spark, flag(F.lit(None).cast("boolean"))) == 0


def test_engineered_features_use_only_what_is_there(spark):
    frame = spark.createDataFrame([(12.0, 40.0)], "T2M__mean double, T2M_MAX__mean double")
    out = engineer_features(frame)
    assert set(out.columns) - set(frame.columns) == {"GDD_base10", "heat_days_35"}
    assert set(ENGINEERED) >= {"GDD_base10", "heat_days_35"}
