"""Registry, table access and the roles the given tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- wanted variables -----------------------------------------------------
# variable, api parameter, source dataset, dataset, frequency, detailed_notes

MAPPING = [
    ("Air temp max", "T2M_MAX", "NASA daily", "POWER point", "daily", "warmest hour"),
    ("Air temp min", "T2M_MIN; T2M_MIN", "NASA daily", "POWER point", "Daily/Seasonal", "coldest hour"),
    ("Mean temp and humidity", "T2M, RH2M", "nasa power", "POWER point", "1", "two values"),
    ("Diurnal range (DTR)", "Derived", "NASA daily", "POWER point", "daily", "max less min"),
    ("Dew-point / dew point temperature", "derived", "NASA daily", "POWER point", "~3 days", "Magnus"),
    ("VPD", "Derived;", "NASA daily", "POWER point", "weekly", "deficit"),
    ("NDVI / EVI", "Derived", "Sentinel-2 tiles", "COPERNICUS/S2", "5 to 10 days", "greenness"),
    ("Bands", "B4, B8A | B11; b2", "Sentinel-2 tiles", "COPERNICUS/S2", "5-8", "raw"),
    ("Chlorophyll index (red edge)", "Derived", "copernicus/s2", "COPERNICUS/S2", "5", "edge"),
    ("Red edge nd index", "x", "copernicus/s2", "COPERNICUS/S2", "n/a", "edge"),
    ("Vegetation condition", "Derived", "MOD13Q1 modis", "MODIS/061", "16", "year range"),
    ("Greenness", "NDVI,EVI", "MOD13Q1 modis", "MODIS/061", "16 days", "grid"),
    ("Leaf area", "Lai_500m", "MOD15A2H modis", "MODIS/061", "8d", "grid"),
    ("ET", "ET; PET", "MOD16A2 (MODIS)", "MODIS/061", "8 to 9", "water"),
    ("Gross production", "Gpp/PsnNet", "MOD17A2H (MODIS)", "MODIS/061", "none", "carbon"),
    ("VV/VH ratio", "Derived", "Sentinel-1 GRD", "COPERNICUS/S1_GRD", "6 to 12 days", "linear"),
    ("Radar vegetation index, VV", "VV_mean; VH max", "C-band SAR", "S1", "12", "structure"),
    ("elevation, slope", "Derived", "SRTM tiles", "USGS", "static", "dem"),
    ("Aspect", "aspect_mean (deg), shade", "srtm", "USGS", "Once", "dem"),
    ("Irrigation", "Derived", "ERA5-Land hourly", "ECMWF", "", "deficit"),
    ("Rain and skin", "total precipitation, skin-temperature", "era5", "ECMWF", "hourly", "land"),
    ("Sand and bulk", "sand_0-5cm_mean; bulk_0-5cm_mean, xyz_1", "ISRIC", "soilgrids", "one-time", "static"),
    ("Clay", "clay 0-5cm mean/balk_5-15cm_mean", "SoilGrids 250m", "soilgrids", "0", "static"),
    ("Market price", "price", "other", "none", "monthly", "unmatched"),
]
MAPPING_NAMES = ["variable", "api parameter", "source dataset", "dataset", "frequency", "detailed_notes"]


def mapping_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, ", ".join(f"`{n}` string" for n in MAPPING_NAMES))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MAPPING_SQL = "mapping({}) AS (VALUES {})".format(
    ", ".join(f'"{n}"' for n in MAPPING_NAMES),
    ",\n  ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in MAPPING),
)

# ---- fields: one per order ------------------------------------------------

FIELDS_SQL = """fields AS (
  SELECT date, latitude, longitude, field_id, area, season, crop_yield FROM (
    SELECT CAST(o_orderdate AS DATE) AS date,
           CAST(40000 + (o_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude,
           CAST(-5000 + o_custkey % 50 AS DOUBLE) / 1000 AS longitude,
           o_orderkey AS field_id, o_orderpriority AS area, o_orderstatus AS season, o_totalprice AS crop_yield,
           row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), (o_custkey * 7) % 1000, o_custkey % 50
                              ORDER BY o_orderkey) AS rn
    FROM orders) WHERE rn = 1)"""


def latitude(key):
    return (F.lit(40000) + (key * 7) % 1000).cast("double") / F.lit(1000.0)


def longitude(key):
    return (F.lit(-5000) + key % 50).cast("double") / F.lit(1000.0)


def raw_fields(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        latitude(F.col("o_custkey")).alias("latitude"), longitude(F.col("o_custkey")).alias("longitude"),
        F.col("o_orderkey").alias("field_id"), F.col("o_orderpriority").alias("area"),
        F.col("o_orderstatus").alias("season"), F.col("o_totalprice").alias("crop_yield"),
    )


# The plan as the fields cross the mapping.
PLAN_SQL = 'plan AS (SELECT f.*, m.* FROM fields f CROSS JOIN mapping m)'

# ---- daily observations and anchors: events -------------------------------

OBS_SQL = """obs AS (
  SELECT user_id AS loc_id, CAST(ts AS DATE) AS obs_date, event_type AS param, CAST(max(value) AS DECIMAL(18,2)) AS value
  FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2, 3)"""
ANCHORS_SQL = """anchors AS (
  SELECT DISTINCT user_id AS loc_id, CAST(ts AS DATE) AS anchor_date FROM events WHERE event_type = 'purchase')"""


def observations(t: Tables) -> DataFrame:
    rows = t("events").filter(F.col("event_type") != "purchase")
    return rows.groupBy(
        F.col("user_id").alias("loc_id"), F.col("ts").cast("date").alias("obs_date"), F.col("event_type").alias("param")
    ).agg(F.max("value").cast("decimal(18,2)").alias("value"))


def anchors(t: Tables) -> DataFrame:
    rows = t("events").filter(F.col("event_type") == "purchase")
    return rows.select(F.col("user_id").alias("loc_id"), F.col("ts").cast("date").alias("anchor_date")).distinct()


# ---- pixels: line items ---------------------------------------------------
# One scene per month; the raster pitch is 0.0005 degrees; one value per scene, band and pixel.

PIXELS_SQL = """pixels AS (
  SELECT scene_id, obs_date, band, px_row, px_col, CAST(80000 + px_row AS DOUBLE) / 2000 AS lat,
         CAST(-10000 + px_col AS DOUBLE) / 2000 AS lon, value
  FROM (SELECT strftime(l_shipdate, 'S%Y%m') AS scene_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS obs_date,
               CASE l_linenumber % 4 WHEN 0 THEN 'B2' WHEN 1 THEN 'B4' WHEN 2 THEN 'B5' ELSE 'B8' END AS band,
               l_partkey % 2000 AS px_row, l_suppkey AS px_col, max(l_quantity * 100) AS value
        FROM lineitem GROUP BY ALL))"""
POINTS_SQL = """points AS (
  SELECT DISTINCT CAST(40000 + (c_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude,
                  CAST(-5000 + c_custkey % 50 AS DOUBLE) / 1000 AS longitude FROM customer)"""
# Great-circle distance of point p and pixel x, in metres.
DISTANCE_SQL = (
    "2 * 6371000.0::DOUBLE * asin(sqrt(least(pow(sin(radians(x.lat - p.latitude) / 2), 2) + cos(radians(p.latitude))"
    " * cos(radians(x.lat)) * pow(sin(radians(x.lon - p.longitude) / 2), 2), 1)))"
)


def region_sql(buffer_m: int, pixels: str = "pixels", name: str = "region") -> str:
    """Pixels within the buffer, with a plain latitude band to keep the check quick; the distance decides."""
    reach = buffer_m / 100000
    return (
        f"{name} AS (SELECT p.latitude, p.longitude, x.* FROM points p JOIN {pixels} x"
        f" ON x.lat BETWEEN p.latitude - {reach} AND p.latitude + {reach} AND {DISTANCE_SQL} <= {buffer_m})"
    )


def pixels(t: Tables) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, ("B2", "B4", "B5", "B8"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    grouped = t("lineitem").groupBy(
        F.date_format("l_shipdate", "'S'yyyyMM").alias("scene_id"), F.trunc("l_shipdate", "month").alias("obs_date"),
        band.alias("band"), (F.col("l_partkey") % 2000).alias("px_row"), F.col("l_suppkey").alias("px_col"),
    ).agg(F.max(F.col("l_quantity") * 100).alias("value"))
    return grouped.withColumns({
        "lat": (F.lit(80000) + F.col("px_row")).cast("double") / F.lit(2000.0),
        "lon": (F.lit(-10000) + F.col("px_col")).cast("double") / F.lit(2000.0),
    })


def points(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t("customer").select(latitude(key).alias("latitude"), longitude(key).alias("longitude")).distinct()


# ---- model rows: orders, with gaps ---------------------------------------

MODEL_SQL = """model AS (
  SELECT o_orderkey AS row_id, o_totalprice AS target, o_orderstatus AS season, o_orderpriority AS area,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000.0::DOUBLE + o_orderkey % 7 END AS x1,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS DOUBLE) END AS x2,
         CAST(o_orderkey % 5 AS DOUBLE) AS x3,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_custkey * o_orderkey) % 101 AS DOUBLE) END AS x4
  FROM orders)"""


def model_rows(t: Tables) -> DataFrame:
    o, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return t("orders").select(
        o.alias("row_id"), price.alias("target"), F.col("o_orderstatus").alias("season"), F.col("o_orderpriority").alias("area"),
        F.when(o % 11 != 0, price / F.lit(1000.0) + o % 7).alias("x1"),
        F.when(o % 13 != 0, (c % 97).cast("double")).alias("x2"),
        (o % 5).cast("double").alias("x3"),
        F.when(o % 17 != 0, ((c * o) % 101).cast("double")).alias("x4"),
    )
