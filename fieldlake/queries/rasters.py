"""Scene selection, buffer joins, zonal statistics, composites and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.operators.grids import focal_median, terrain
from fieldlake.operators.joins import buffer_join, filter_bounds, window_join
from fieldlake.operators.zonal import daily_reduce, median_composite, vci_by_region, year_extremes, zonal_stats
from fieldlake.queries.base import PIXELS_SQL, POINTS_SQL, Tables, ctes, latitude, longitude, pixels, points, query, region_sql
from fieldlake.sources.scenes import scene_pixels, select_scenes

PLACE = ["latitude", "longitude"]

# Scenes: one per order; the order's fields play the metadata.
_SCENES = """scenes AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'S2' WHEN 1 THEN 'S1' ELSE 'MOD13Q1' END AS product, o_orderkey AS scene_id, o_orderdate AS scene_ts,
  CAST(o_custkey % 100 AS DOUBLE) AS cloud_pct, CASE WHEN o_orderstatus = 'F' THEN 'EW' ELSE 'IW' END AS instrument_mode,
  CASE WHEN o_custkey % 4 = 0 THEN ['VV'] ELSE ['VV', 'VH'] END AS polarisations, CASE WHEN o_custkey % 5 = 0 THEN 25 ELSE 10 END AS resolution_m FROM orders)"""
_USABLE = "product = 'S2' AND cloud_pct < 20", "product = 'S1' AND instrument_mode = 'IW' AND resolution_m = 10 AND len(polarisations) = 2", "product = 'MOD13Q1'"


def scenes(t: Tables) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select(
        F.when(o % 3 == 0, "S2").when(o % 3 == 1, "S1").otherwise("MOD13Q1").alias("product"), o.alias("scene_id"), F.col("o_orderdate").alias("scene_ts"),
        (c % 100).cast("double").alias("cloud_pct"), F.when(F.col("o_orderstatus") == "F", "EW").otherwise("IW").alias("instrument_mode"),
        F.when(c % 4 == 0, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"),
        F.when(c % 5 == 0, 25).otherwise(10).alias("resolution_m"),
    )


@query("usable_scenes", ctes(_SCENES) + f"SELECT product, scene_id, cloud_pct FROM scenes WHERE ({_USABLE[0]}) OR ({_USABLE[1]}) OR ({_USABLE[2]})")
def usable_scenes(t: Tables) -> DataFrame:
    all_scenes = scenes(t)
    picked = [select_scenes(all_scenes, p).select("product", "scene_id", "cloud_pct") for p in ("S2", "S1", "MOD13Q1")]
    return picked[0].union(picked[1]).union(picked[2])


@query("pixels_of_usable_scenes", ctes(_SCENES) + f"""
SELECT scene_id, l_linenumber, l_partkey, l_suppkey, CAST(scene_ts AS DATE) AS scene_date FROM lineitem JOIN scenes ON l_orderkey = scene_id
WHERE {_USABLE[1]} AND l_returnflag IN ('A', 'N')""")
def pixels_of_usable_scenes(t: Tables) -> DataFrame:
    rows = t("lineitem").select(
        F.lit("S1").alias("product"), F.col("l_orderkey").alias("scene_id"), F.col("l_returnflag").alias("band"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    out = scene_pixels(select_scenes(scenes(t), "S1"), rows, ["A", "N"])
    return out.select("scene_id", "l_linenumber", "l_partkey", "l_suppkey", F.col("scene_ts").cast("date").alias("scene_date"))


@query("scenes_covering_points", ctes(PIXELS_SQL, POINTS_SQL, region_sql(100)) + "SELECT DISTINCT 'L8' AS product, scene_id FROM region")
def scenes_covering_points(t: Tables) -> DataFrame:
    return filter_bounds(pixels(t).withColumn("product", F.lit("L8")), points(t), 100)


@query("pixels_in_buffer", ctes(PIXELS_SQL, POINTS_SQL, region_sql(500)) + "SELECT latitude, longitude, scene_id, band, px_row, px_col, value FROM region")
def pixels_in_buffer(t: Tables) -> DataFrame:
    return buffer_join(points(t), pixels(t), 500).select(*PLACE, "scene_id", "band", "px_row", "px_col", "value")


_STATS = """CAST(sum(CAST(value AS BIGINT)) AS DOUBLE) / count(value) AS mean, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max, round(stddev_pop(value), 5) AS "stdDev" """


@query("zonal_statistics", ctes(PIXELS_SQL, POINTS_SQL, region_sql(500)) + f"SELECT latitude, longitude, band, {_STATS} FROM region GROUP BY ALL")
def zonal_statistics(t: Tables) -> DataFrame:
    region = buffer_join(points(t), pixels(t), 500).withColumn("value", F.col("value").cast("bigint"))
    return zonal_stats(region, [*PLACE, "band"], ("mean", "min", "max", "stdDev")).withColumn("stdDev", F.round("stdDev", 5))


# Anchors for rasters: the months after which each customer ordered.
_DATES = """dates AS (SELECT DISTINCT CAST(40000 + (o_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude, CAST(-5000 + o_custkey % 50 AS DOUBLE) / 1000 AS longitude,
  CAST(o_orderdate AS DATE) AS anchor_date FROM orders)"""


def _dates(t: Tables) -> DataFrame:
    return t("orders").select(
        latitude(F.col("o_custkey")).alias("latitude"), longitude(F.col("o_custkey")).alias("longitude"), F.col("o_orderdate").cast("date").alias("anchor_date")
    ).distinct()


@query("median_composites", ctes(PIXELS_SQL, POINTS_SQL, region_sql(450), _DATES) + """, m AS (
  SELECT latitude, longitude, anchor_date, band, px_row, px_col, median(value) AS value FROM dates JOIN region USING (latitude, longitude)
  WHERE obs_date >= anchor_date - 100 AND obs_date < anchor_date + 100 GROUP BY ALL)
SELECT latitude, longitude, anchor_date, band, CAST(sum(CAST(value * 2 AS BIGINT)) AS DOUBLE) / 2 / count(*) AS mean, min(value) AS min, max(value) AS max FROM m GROUP BY ALL""")
def median_composites(t: Tables) -> DataFrame:
    """Median per pixel over the scenes of the window, then region statistics."""
    region = buffer_join(points(t), pixels(t), 450)
    hits = window_join(_dates(t), region, PLACE, 100, 100, "left")
    composite = median_composite(hits, [*PLACE, "anchor_date", "band", "px_row", "px_col"])
    return zonal_stats(composite, [*PLACE, "anchor_date", "band"])


_HOURLY = """h AS (SELECT l_suppkey AS px, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber % 2 = 0 THEN 'total_precipitation' ELSE 'skin_temperature' END AS band,
  CAST(l_quantity AS DECIMAL(18,2)) AS value FROM lineitem)"""


@query("daily_reduction", ctes(_HOURLY) + """
SELECT px, day, band, CASE WHEN band = 'total_precipitation' THEN CAST(sum(value) AS DOUBLE) ELSE CAST(sum(value) AS DOUBLE) / count(value) END AS value FROM h GROUP BY px, day, band""")
def daily_reduction(t: Tables) -> DataFrame:
    band = F.when(F.col("l_linenumber") % 2 == 0, "total_precipitation").otherwise("skin_temperature")
    hourly = t("lineitem").select(
        F.col("l_suppkey").alias("px"), F.col("l_shipdate").cast("date").alias("day"), band.alias("band"), F.col("l_quantity").cast("decimal(18,2)").alias("value")
    )
    return daily_reduce(hourly, ["px", "day", "band"], ("total_precipitation", "potential_evaporation"))


@query("condition_index", ctes(PIXELS_SQL, POINTS_SQL, region_sql(500)) + """, e AS (
  SELECT latitude, longitude, year(obs_date) AS year, px_row, px_col, CAST(min(value) AS BIGINT) AS low, CAST(max(value) AS BIGINT) AS high FROM region GROUP BY ALL),
y AS (SELECT latitude, longitude, year, CAST(sum(low) AS DOUBLE) / count(*) AS low, CAST(sum(high) AS DOUBLE) / count(*) AS high FROM e GROUP BY ALL),
c AS (SELECT latitude, longitude, year(obs_date) AS year, CAST(sum(CAST(value AS BIGINT)) AS DOUBLE) / count(*) AS current FROM region GROUP BY ALL)
SELECT latitude, longitude, CAST(year AS INT) AS year, round((current - low) / (high - low), 9) AS "VCI" FROM c JOIN y USING (latitude, longitude, year) WHERE high <> low""")
def condition_index(t: Tables) -> DataFrame:
    region = buffer_join(points(t), pixels(t), 500).withColumns({"year": F.year("obs_date"), "value": F.col("value").cast("bigint")})
    by = [*PLACE, "year"]
    extremes = year_extremes(region, [*by, "px_row", "px_col"])
    current = region.groupBy(*by).agg((F.sum("value").cast("double") / F.count("*")).alias("current"))
    return vci_by_region(extremes, current, by).withColumn("VCI", F.round("VCI", 9))


# Dense rasters for the neighbourhood operators: part x supplier, one value each.
_DENSE = "g AS (SELECT l_linenumber AS band, l_partkey % 500 AS px_row, l_suppkey % 60 AS px_col, CAST(max(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def _dense(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(
        F.col("l_linenumber").alias("band"), (F.col("l_partkey") % 500).alias("px_row"), (F.col("l_suppkey") % 60).alias("px_col")
    ).agg(F.max("l_quantity").alias("value"))


@query("speckle_filter", ctes(_DENSE) + """
SELECT a.band, a.px_row, a.px_col, median(b.value) AS value FROM g a JOIN g b ON a.band = b.band AND b.px_row BETWEEN a.px_row - 1 AND a.px_row + 1
AND b.px_col BETWEEN a.px_col - 1 AND a.px_col + 1 GROUP BY ALL""")
def speckle_filter(t: Tables) -> DataFrame:
    return focal_median(_dense(t), ["band"], tile=64)


_DEM = "d AS (SELECT l_partkey % 500 AS px_row, l_suppkey % 60 AS px_col, CAST(max(l_extendedprice) AS DOUBLE) / 1000 AS value FROM lineitem GROUP BY ALL)"


@query("terrain_layers", ctes(_DEM, """
n AS (SELECT c.px_row, c.px_col, c.value AS z, (e.value - w.value) / 60.0::DOUBLE AS dx, (n.value - s.value) / 60.0::DOUBLE AS dy FROM d c
  LEFT JOIN d e ON e.px_row = c.px_row AND e.px_col = c.px_col + 1 LEFT JOIN d w ON w.px_row = c.px_row AND w.px_col = c.px_col - 1
  LEFT JOIN d n ON n.px_row = c.px_row + 1 AND n.px_col = c.px_col LEFT JOIN d s ON s.px_row = c.px_row - 1 AND s.px_col = c.px_col)""", """
a AS (SELECT *, atan(sqrt(dx * dx + dy * dy)) AS st, atan2(-dx, -dy) AS az FROM n)""") + """
SELECT px_row, px_col, z AS elevation, round(degrees(st), 6) AS slope, round(CASE WHEN st = 0 THEN 0 WHEN degrees(az) < 0 THEN degrees(az) + 360 ELSE degrees(az) END, 6) AS aspect,
  round(CASE WHEN st IS NULL THEN NULL ELSE 255 * greatest(cos(radians(45.0)) * cos(st) + sin(radians(45.0)) * sin(st) * cos(radians(270.0) - az), 0) END, 5) AS hillshade FROM a""")
def terrain_layers(t: Tables) -> DataFrame:
    dem = t("lineitem").groupBy((F.col("l_partkey") % 500).alias("px_row"), (F.col("l_suppkey") % 60).alias("px_col")).agg((F.max("l_extendedprice") / 1000).alias("value"))
    out = terrain(dem, 30.0)
    return out.select("px_row", "px_col", "elevation", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"), F.round("hillshade", 5).alias("hillshade"))
