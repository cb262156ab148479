"""Whole stages over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ModelConfig, OpticalConfig, RadarConfig
from fieldlake.naming import KEYS, col
from fieldlake.operators import models as M
from fieldlake.plans.fetch import build_fetch_plan
from fieldlake.queries.base import (
    FIELDS_SQL, MAPPING_SQL, POINTS_SQL, Tables, ctes, latitude, longitude, mapping_frame, query, raw_fields, region_sql,
)
from fieldlake.session import shared_dir
from fieldlake.sources.state import load_state, save_state
from fieldlake.sources.tables import read_table, stage, write_table
from fieldlake.stages import optical_stage, radar_stage, reanalysis_stage, run_all, run_model, soil_stage, terrain_stage, weather_stage

_KEY = "date, latitude, longitude"


def _scratch(t: Tables) -> str:
    """A new folder under the cluster's shared folder."""
    return f"{shared_dir(t.spark)}/fieldlake-{uuid.uuid4().hex}"


def _plan(t: Tables) -> DataFrame:
    return build_fetch_plan(raw_fields(t), mapping_frame(t.spark), ["field_id"])


def _rounded(df: DataFrame, names: list[str], places: int) -> DataFrame:
    return df.select(*(F.round(col(c), places).alias(c) if c in names else col(c) for c in df.columns))


# ---- weather --------------------------------------------------------------

_PARAMS = {"view": "T2M_MAX", "click": "T2M_MIN", "error": "T2M", "signup": "RH2M"}
_PLACE_SQL = "CAST(40000 + (user_id * 7) % 1000 AS DOUBLE) / 1000 AS latitude, CAST(-5000 + user_id % 50 AS DOUBLE) / 1000 AS longitude"
_NAMES = ["T2M_MAX", "T2M_MIN", "T2M", "RH2M", "DTR", "VPD", "DEW POINT TEMPERATURE"]
_WEATHER_SQL = ctes(
    f"keys AS (SELECT DISTINCT CAST(ts AS DATE) AS date, {_PLACE_SQL} FROM events WHERE event_type = 'purchase')",
    f"base AS (SELECT {_PLACE_SQL}, CAST(ts AS DATE) AS day, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{p}'" for e, p in _PARAMS.items())
    + " END AS param, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ALL)",
    "wide AS (SELECT latitude, longitude, day, " + ", ".join(f"max(value) FILTER (WHERE param = '{p}') AS {p}" for p in _PARAMS.values()) + " FROM base GROUP BY ALL)",
    "g AS (SELECT *, 17.27 * T2M / (237.7 + T2M) + CASE WHEN RH2M > 0 THEN ln(RH2M / 100) END AS g FROM wide)",
    """obs AS (SELECT * FROM base WHERE value IS NOT NULL UNION ALL SELECT latitude, longitude, day, 'DTR', T2M_MAX - T2M_MIN FROM wide WHERE T2M_MAX - T2M_MIN IS NOT NULL
  UNION ALL SELECT latitude, longitude, day, 'VPD', 0.6108 * exp(17.27 * T2M / (T2M + 237.3)) * (1 - RH2M / 100) FROM wide WHERE T2M + RH2M IS NOT NULL
  UNION ALL SELECT latitude, longitude, day, 'DEW POINT TEMPERATURE', 237.7 * g / (17.27 - g) FROM g WHERE g IS NOT NULL)""",
    "w AS (SELECT k.*, o.day, o.param, o.value FROM keys k JOIN obs o USING (latitude, longitude) WHERE day BETWEEN date - 15 AND date + 15)",
    f"b AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY abs(date_diff('day', date, day)), day) = 1 AS first FROM w)",
    f"n AS (SELECT {_KEY}, day AS best FROM b WHERE first)",
)


def _weather(t: Tables) -> tuple[DataFrame, DataFrame]:
    events = t("events")
    place = [latitude(F.col("user_id")).alias("latitude"), longitude(F.col("user_id")).alias("longitude")]
    fields = events.filter("event_type = 'purchase'").select(F.col("ts").cast("date").alias("date"), *place).distinct()
    names = F.create_map(*(F.lit(v) for pair in _PARAMS.items() for v in pair))
    obs = events.filter("event_type <> 'purchase'").groupBy(
        *place, F.col("ts").cast("date").alias("date"), names[F.col("event_type")].alias("param")
    ).agg(F.max("value").alias("value"))
    return weather_stage(build_fetch_plan(fields, mapping_frame(t.spark)), obs)


@query("weather_stage_daily", _WEATHER_SQL + f"SELECT {_KEY}, " + ", ".join(
    f"round(max(value) FILTER (WHERE param = '{p}'), 6) AS \"{p}\"" for p in _NAMES) + f" FROM keys LEFT JOIN n USING ({_KEY}) LEFT JOIN w USING ({_KEY}) WHERE day = best GROUP BY ALL")
def weather_stage_daily(t: Tables) -> DataFrame:
    return _rounded(_weather(t)[0], _NAMES, 6)


@query("weather_stage_statistics", _WEATHER_SQL + f"SELECT {_KEY}, " + ", ".join(
    f"round({f}(value) FILTER (WHERE param = '{p}'), 7) AS \"{p}__{s}\"" for p in _NAMES for s, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop"))) + " FROM w GROUP BY ALL")
def weather_stage_statistics(t: Tables) -> DataFrame:
    stats = _weather(t)[1]
    return _rounded(stats, [c for c in stats.columns if c not in KEYS], 7)


# ---- rasters --------------------------------------------------------------
# Each line item is one pixel of its month's scene, with all bands.

_PX_SQL = """px AS (SELECT strftime(l_shipdate, 'S%Y%m') AS scene_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS obs_date, l_partkey % 2000 AS px_row, l_suppkey AS px_col,
  CAST(80000 + l_partkey % 2000 AS DOUBLE) / 2000 AS lat, CAST(-10000 + l_suppkey AS DOUBLE) / 2000 AS lon, max(l_quantity) AS q, max(l_tax) AS tax, max(l_discount) AS disc
  FROM lineitem GROUP BY ALL)"""


def _px(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(
        F.date_format("l_shipdate", "'S'yyyyMM").alias("scene_id"), F.trunc("l_shipdate", "month").alias("obs_date"),
        (F.col("l_partkey") % 2000).alias("px_row"), F.col("l_suppkey").alias("px_col"),
    ).agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc")).withColumns({
        "lat": (F.lit(80000) + F.col("px_row")).cast("double") / F.lit(2000.0), "lon": (F.lit(-10000) + F.col("px_col")).cast("double") / F.lit(2000.0),
    })


def _long(px: DataFrame, bands: dict) -> DataFrame:
    """(product, band) -> value expression, as a long pixel table."""
    cells = F.array(*(F.struct(F.lit(p).alias("product"), F.lit(b).alias("band"), v.cast("double").alias("value")) for (p, b), v in bands.items()))
    rows = px.select("scene_id", "px_row", "px_col", "lat", "lon", F.explode(cells).alias("_c"))
    return rows.select("scene_id", "px_row", "px_col", "lat", "lon", "_c.product", "_c.band", "_c.value")


def _scenes(t: Tables, products: list[str]) -> DataFrame:
    months = t("lineitem").select(F.date_format("l_shipdate", "'S'yyyyMM").alias("scene_id"), F.trunc("l_shipdate", "month").cast("timestamp").alias("scene_ts")).distinct()
    return months.withColumn("product", F.explode(F.array(*map(F.lit, products)))).withColumns({
        "cloud_pct": F.pmod(F.month("scene_ts") * 7, F.lit(30)).cast("double"), "instrument_mode": F.lit("IW"),
        "polarisations": F.array(F.lit("VV"), F.lit("VH")), "resolution_m": F.lit(10),
    })


_OPT = {"b": "(tax * 1000 + 200) / 10000", "r": "(disc * 1000 + 300) / 10000", "e": "(q * 20 + 800) / 10000", "n": "(q * 41 + 1500) / 10000"}
_CLEAR = "CAST(q AS INT) % 12 NOT IN (3, 6, 8, 9, 10, 11)"


def _picked(region: str, days: int, values: dict[str, str], name: str) -> str:
    """Statistics of the earliest scene in the window of each key."""
    cells = ", ".join(f"{f}({v}) AS \"{c}__{s}\"" for c, v in values.items() for s, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    return (f"{name}_pick AS (SELECT f.date, f.latitude, f.longitude, min(r.obs_date) AS obs_date FROM fields f JOIN {region} r USING (latitude, longitude)"
            f" WHERE r.obs_date >= f.date - {days} AND r.obs_date < f.date + {days} GROUP BY ALL),\n"
            f"{name} AS (SELECT p.date, p.latitude, p.longitude, {cells} FROM {name}_pick p JOIN {region} r USING (latitude, longitude, obs_date) GROUP BY ALL)")


_S2_VALUES = {
    "NDVI": f"({_OPT['n']} - {_OPT['r']}) / ({_OPT['n']} + {_OPT['r']})", "NDRE": f"({_OPT['n']} - {_OPT['e']}) / ({_OPT['n']} + {_OPT['e']})",
    "B4": "disc * 1000 + 300", "b2": "tax * 1000 + 200",
}
_OPTICAL_COLUMNS = [f"{c}__{s}" for c in (*_S2_VALUES, "ET", "Lai_500m") for s in ("mean", "min", "max")]


@query("optical_stage", ctes(
    FIELDS_SQL, _PX_SQL, POINTS_SQL, region_sql(500, "px"),
    f"clear AS (SELECT * FROM region WHERE {_CLEAR} AND (month(obs_date) * 7) % 30 < 20)",
    _picked("clear", 40, _S2_VALUES, "s2"), _picked("region", 8, {"ET": "q + disc"}, "et"), _picked("region", 16, {"Lai_500m": "q / 10"}, "lai"),
) + f"SELECT {_KEY}, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _OPTICAL_COLUMNS)
    + f" FROM s2 FULL JOIN et USING ({_KEY}) FULL JOIN lai USING ({_KEY})")
def optical_stage_rows(t: Tables) -> DataFrame:
    """Sentinel-like and land products; the condition index and plain means have checks of their own."""
    q, tax, disc = F.col("q"), F.col("tax"), F.col("disc")
    bands = {
        ("S2", "B2"): tax * 1000 + 200, ("S2", "B4"): disc * 1000 + 300, ("S2", "B5"): q * 20 + 800, ("S2", "B8"): q * 41 + 1500, ("S2", "SCL"): q.cast("int") % 12,
        ("MOD16A2", "ET"): q + disc, ("MOD15A2H", "Lai_500m"): q / 10,
    }
    products = ("S2", "MOD16A2", "MOD15A2H")
    out = optical_stage(_plan(t), _scenes(t, list(products)), _long(_px(t), bands), OpticalConfig(s2_days=40), products)
    return _rounded(out.select(*KEYS, *_OPTICAL_COLUMNS), _OPTICAL_COLUMNS, 6)


@query("optical_stage_condition_index")
def optical_stage_condition_index(t: Tables) -> DataFrame:
    bands = {("MOD13Q1", "NDVI"): F.col("q") / 50, ("MOD13Q1", "EVI"): F.col("disc")}
    out = optical_stage(_plan(t), _scenes(t, ["MOD13Q1"]), _long(_px(t), bands), products=("MOD13Q1",))
    return _rounded(out, ["NDVI", "EVI", "VCI", "NDVI__mean"], 6)


_RADAR_COLUMNS = [f"{g}__{s}" for g in ("VV", "VH", "VVVH_ratio", "RVI") for s in ("mean", "stdDev", "min", "max")]


@query("radar_stage", ctes(
    FIELDS_SQL, _PX_SQL, POINTS_SQL, "raw AS (SELECT *, -5 - q / 10 AS vv, -12 - disc * 50 AS vh FROM px)",
    """smooth AS (SELECT a.scene_id, a.obs_date, a.px_row, a.px_col, a.lat, a.lon, median(b.vv) AS vv, median(b.vh) AS vh FROM raw a JOIN raw b ON a.scene_id = b.scene_id
  AND b.px_row BETWEEN a.px_row - 1 AND a.px_row + 1 AND b.px_col BETWEEN a.px_col - 1 AND a.px_col + 1 GROUP BY ALL)""", region_sql(450, "smooth"),
    f"""comp AS (SELECT f.date, latitude, longitude, px_row, px_col, median(vv) AS vv, median(vh) AS vh FROM fields f JOIN region r USING (latitude, longitude)
  WHERE obs_date >= date - 25 AND obs_date < date + 25 GROUP BY ALL)""",
    "lin AS (SELECT *, pow(10, vv / 10) AS a, pow(10, vh / 10) AS b FROM comp)",
) + f"SELECT {_KEY}, " + ", ".join(
    f"round(CASE WHEN abs({f}({v})) > 1e-9 THEN {f}({v}) END, 5) AS \"{g}__{s}\"" for g, v in (("VV", "vv"), ("VH", "vh"), ("VVVH_ratio", "a / b"), ("RVI", "4 * b / (a + b)"))
    for s, f in (("mean", "avg"), ("stdDev", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM lin GROUP BY ALL")
def radar_stage_rows(t: Tables) -> DataFrame:
    bands = {("S1", "VV"): F.lit(-5) - F.col("q") / 10, ("S1", "VH"): F.lit(-12) - F.col("disc") * 50}
    out = radar_stage(_plan(t), _scenes(t, ["S1"]), _long(_px(t), bands), RadarConfig(pixel_m=60.0))
    noise = out.select(*KEYS, *(F.when(F.abs(col(c)) > 1e-9, col(c)).alias(c) for c in _RADAR_COLUMNS))
    return _rounded(noise, _RADAR_COLUMNS, 5)


_DEM_SQL = """dem AS (SELECT l_partkey % 2000 AS px_row, l_suppkey AS px_col, CAST(80000 + l_partkey % 2000 AS DOUBLE) / 2000 AS lat, CAST(-10000 + l_suppkey AS DOUBLE) / 2000 AS lon,
  floor(max(l_extendedprice) / 100) AS value FROM lineitem GROUP BY ALL)"""
_SLOPES_SQL = """n AS (SELECT c.*, (e.value - w.value) / 110.0::DOUBLE AS dx, (n.value - s.value) / 110.0::DOUBLE AS dy FROM dem c
  LEFT JOIN dem e ON e.px_row = c.px_row AND e.px_col = c.px_col + 1 LEFT JOIN dem w ON w.px_row = c.px_row AND w.px_col = c.px_col - 1
  LEFT JOIN dem n ON n.px_row = c.px_row + 1 AND n.px_col = c.px_col LEFT JOIN dem s ON s.px_row = c.px_row - 1 AND s.px_col = c.px_col),
layers AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN atan2(-dx, -dy) < 0 THEN degrees(atan2(-dx, -dy)) + 360 ELSE degrees(atan2(-dx, -dy)) END AS aspect FROM n)"""
_TERRAIN_COLUMNS = ["elevation__mean", "elevation__stdDev", "elevation__min", "elevation__max", "slope__mean", "slope__max", "aspect__mean", "aspect__max"]


@query("terrain_stage", ctes(FIELDS_SQL, POINTS_SQL, _DEM_SQL, _SLOPES_SQL, region_sql(600, "layers"), """
z AS (SELECT latitude, longitude, avg(value) AS elevation__mean, nullif(round(stddev_pop(value), 5), 0) AS "elevation__stdDev", min(value) AS elevation__min, max(value) AS elevation__max,
  avg(slope) AS slope__mean, max(slope) AS slope__max, avg(aspect) AS aspect__mean, max(aspect) AS aspect__max FROM region GROUP BY ALL)""")
  + f"SELECT {_KEY}, " + ", ".join(f'round("{c}", 5) AS "{c}"' for c in _TERRAIN_COLUMNS) + " FROM fields JOIN z USING (latitude, longitude)")
def terrain_stage_rows(t: Tables) -> DataFrame:
    dem = t("lineitem").groupBy((F.col("l_partkey") % 2000).alias("px_row"), F.col("l_suppkey").alias("px_col")).agg(F.floor(F.max("l_extendedprice") / 100).cast("double").alias("value"))
    placed = dem.withColumns({"lat": (F.lit(80000) + F.col("px_row")).cast("double") / F.lit(2000.0), "lon": (F.lit(-10000) + F.col("px_col")).cast("double") / F.lit(2000.0)})
    return _rounded(terrain_stage(_plan(t), placed, 55.0).select(*KEYS, *_TERRAIN_COLUMNS), _TERRAIN_COLUMNS, 5)


_GROUND_SQL = """g AS (SELECT CAST(l_shipdate AS DATE) AS day, l_linenumber, l_partkey % 2000 AS px_row, l_suppkey AS px_col, CAST(80000 + l_partkey % 2000 AS DOUBLE) / 2000 AS lat,
  CAST(-10000 + l_suppkey AS DOUBLE) / 2000 AS lon, l_quantity AS q FROM lineitem)"""


def _ground(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.col("l_shipdate").cast("date").alias("ts"), "l_linenumber", (F.col("l_partkey") % 2000).alias("px_row"), F.col("l_suppkey").alias("px_col"),
        (F.lit(80000) + F.col("l_partkey") % 2000).cast("double").alias("_la"), F.col("l_quantity").alias("q"),
    ).select("*", (F.col("_la") / F.lit(2000.0)).alias("lat"), ((F.lit(-10000) + F.col("px_col")).cast("double") / F.lit(2000.0)).alias("lon")).drop("_la")


_REANALYSIS_CTES = [
    region_sql(600, "g"),
    "e AS (SELECT latitude, longitude, day AS date, CASE l_linenumber % 3 WHEN 0 THEN 'total_precipitation' WHEN 1 THEN 'potential_evaporation' ELSE 'skin_temperature' END AS band, px_row, px_col, q FROM region)",
    """d AS (SELECT latitude, longitude, date, band, px_row, px_col, CASE band WHEN 'total_precipitation' THEN sum(q / 1000) WHEN 'potential_evaporation' THEN sum(-q / 700) ELSE avg(280 + q / 3) END AS v
  FROM e GROUP BY latitude, longitude, date, band, px_row, px_col)""",
    f"""era AS (SELECT {_KEY}, avg(v) FILTER (WHERE band = 'total_precipitation') AS tp, max(v) FILTER (WHERE band = 'total_precipitation') AS tpx, avg(v) FILTER (WHERE band = 'potential_evaporation') AS pe,
  max(v) FILTER (WHERE band = 'potential_evaporation') AS pex, avg(v) FILTER (WHERE band = 'skin_temperature') AS st FROM d JOIN fields USING ({_KEY}) GROUP BY ALL)""",
    f"""reanalysis AS (SELECT {_KEY}, round_even(tp * 1000, 3) AS total_precipitation__mean, round_even(tpx * 1000, 3) AS total_precipitation__max, round_even(pe * -1000, 3) AS potential_evaporation__mean,
  round_even(pex * -1000, 3) AS potential_evaporation__min, round_even(st - 273.15, 2) AS skin_temperature__mean, CASE WHEN pe + tp IS NOT NULL THEN round_even(greatest(0, -(pe + tp) * 1000), 3) END AS irrigation_mm FROM era)""",
]
_REANALYSIS_COLUMNS = ["total_precipitation__mean", "total_precipitation__max", "potential_evaporation__mean", "potential_evaporation__min", "skin_temperature__mean", "irrigation_mm"]


def _reanalysis(t: Tables, plan: DataFrame) -> DataFrame:
    kind, q = F.col("l_linenumber") % 3, F.col("q")
    hourly = _ground(t).withColumns({
        "band": F.when(kind == 0, "total_precipitation").when(kind == 1, "potential_evaporation").otherwise("skin_temperature"),
        "value": F.when(kind == 0, q / 1000).when(kind == 1, -q / 700).otherwise(F.lit(280) + q / 3),
    })
    return reanalysis_stage(plan, hourly).select(*KEYS, *_REANALYSIS_COLUMNS)


@query("reanalysis_stage", ctes(FIELDS_SQL, POINTS_SQL, _GROUND_SQL, *_REANALYSIS_CTES) + "SELECT * FROM reanalysis")
def reanalysis_stage_rows(t: Tables) -> DataFrame:
    return _reanalysis(t, _plan(t))


_SOIL_BANDS = ["sand_0-5cm_mean", "bdod_0-5cm_mean", "clay_0-5cm_mean", "bdod_5-15cm_mean"]
_SOIL_COLUMNS = [f"{b}__{s}" for b in _SOIL_BANDS for s in ("mean", "min", "max")]
_SOIL_CTES = [
    region_sql(600, "g", "soil_region"),
    "soil AS (SELECT f.date, latitude, longitude, " + ", ".join(
        f"{f}(q) FILTER (WHERE l_linenumber % 4 = {i}) AS \"{b}__{s}\"" for i, b in enumerate(_SOIL_BANDS) for s, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + " FROM fields f JOIN soil_region USING (latitude, longitude) GROUP BY ALL)",
]


def _soil(t: Tables, plan: DataFrame) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, _SOIL_BANDS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return soil_stage(plan, _ground(t).withColumns({"band": band, "value": F.col("q")})).select(*KEYS, *_SOIL_COLUMNS)


@query("soil_stage", ctes(FIELDS_SQL, POINTS_SQL, _GROUND_SQL, *_SOIL_CTES) + f"SELECT {_KEY}, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _SOIL_COLUMNS) + " FROM soil")
def soil_stage_rows(t: Tables) -> DataFrame:
    return _rounded(_soil(t, _plan(t)), _SOIL_COLUMNS, 6)


# ---- master ---------------------------------------------------------------

_MASTER_SQL = ctes(FIELDS_SQL, POINTS_SQL, _GROUND_SQL, *_REANALYSIS_CTES, *_SOIL_CTES)
_MASTER_COLUMNS = ["total_precipitation__mean", "irrigation_mm", "sand_0-5cm_mean__mean", "clay_0-5cm_mean__max"]


def _master(t: Tables) -> tuple[DataFrame, DataFrame]:
    plan = _plan(t)
    builders = {"era5_land": lambda: _reanalysis(t, plan), "soilgrids": lambda: _soil(t, plan)}
    return run_all(t.spark, plan, builders, _scratch(t))


@query("master_table", _MASTER_SQL + f"SELECT {_KEY}, area AS fp_area, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _MASTER_COLUMNS)
       + f" FROM reanalysis FULL JOIN soil USING ({_KEY}) LEFT JOIN fields USING ({_KEY})")
def master_table(t: Tables) -> DataFrame:
    return _rounded(_master(t)[0].select(*KEYS, "fp_area", *_MASTER_COLUMNS), _MASTER_COLUMNS, 6)


@query("master_manifest", _MASTER_SQL + f", m AS (SELECT * FROM reanalysis FULL JOIN soil USING ({_KEY}) LEFT JOIN fields USING ({_KEY})) " + " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{s}' AS source, count(\"{c}\") AS n_filled FROM m" for n, s, c in (
        *((k, "key", k) for k in KEYS), *((f"fp_{c}", "fetch_plan_meta", c) for c in ("field_id", "area", "season", "crop_yield")),
        *((c, "era5_land", c) for c in _REANALYSIS_COLUMNS), *((c, "soilgrids", c) for c in _SOIL_COLUMNS))))
def master_manifest(t: Tables) -> DataFrame:
    return _master(t)[1].select("column", "source", "n_filled")


# ---- sinks ----------------------------------------------------------------

@query("table_round_trip", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority FROM orders")
def table_round_trip(t: Tables) -> DataFrame:
    path = _scratch(t)
    write_table(t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_orderpriority"), path, partition_by=["o_orderpriority"])
    return read_table(t.spark, path).select("o_orderkey", "order_date", "o_orderpriority")


@query("csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_round_trip(t: Tables) -> DataFrame:
    """Texts with quotes and line breaks through CSV."""
    path = _scratch(t)
    write_table(t("documents").select("doc_id", F.col("text").alias("text")), path, "csv")
    return read_table(t.spark, path, "csv", multi_line=True)


@query("reused_stage", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def reused_stage(t: Tables) -> DataFrame:
    path = _scratch(t)
    stage(t.spark, path, lambda: t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    return stage(t.spark, path, lambda: t("orders").select(F.lit(0).alias("o_custkey"), F.lit(0).alias("n")))


@query("stored_state", "SELECT 'o_totalprice' AS feature, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders")
def stored_state(t: Tables) -> DataFrame:
    from fieldlake.operators.prep import median_impute_fit

    path = _scratch(t)
    save_state({"medians": median_impute_fit(t("orders"), ["o_totalprice"])}, path)
    return _rounded(load_state(t.spark, path, ["medians"])["medians"], ["median"], 6)


# ---- model run ------------------------------------------------------------

def model_master(t: Tables) -> DataFrame:
    """Orders in the shape of a master table, with gaps."""
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return t("orders").select(
        o.alias("row_id"), F.col("o_orderdate").cast("date").alias("date"), p.alias("yield"), F.col("o_orderpriority").alias("fp_Area"), F.col("o_orderstatus").alias("fp_Season"),
        F.when(o % 11 != 0, p / 10000 + o % 7).alias("T2M__mean"), F.when(o % 13 != 0, (c % 97).cast("double")).alias("NDVI__mean"),
        (o % 5 + p / 100000).alias("sand_0-5cm_mean__mean"), (c % 31 + p / 50000).alias("clay_0-5cm_mean__mean"), (o % 3 + p / 70000).alias("elevation__mean"),
        (-(c % 19) - p / 90000).alias("VV__mean"), (-(o % 23) - p / 80000).alias("VH__mean"), (p / 30000 + c % 5).alias("total_precipitation__mean"),
    )


@query("model_run_metrics")
def model_run_metrics(t: Tables) -> DataFrame:
    cfg = ModelConfig(target="yield", category_columns=("fp_Area", "fp_Season"), group_columns=("no_such_column",), folds=2, features=6)
    tried = [M.rf_spec(trees=10, depth=5), M.elastic_net_spec(ratios=(0.5,), penalties=(0.01,), inner=2)]
    return run_model(model_master(t), tried, cfg).report
