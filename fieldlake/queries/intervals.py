"""Interval and as-of joins, window statistics, key merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.weather import dtr
from fieldlake.naming import KEYS
from fieldlake.operators.joins import asof_earliest, asof_nearest, attach_meta, build_master, merge_source, window_join
from fieldlake.operators.zonal import daily_values, pivot_stats, suppress_zero, window_stats
from fieldlake.queries.base import ANCHORS_SQL, OBS_SQL, Tables, anchors, ctes, latitude, longitude, observations, query
from fieldlake.session import salted_join

_BASE = ctes(ANCHORS_SQL, OBS_SQL)
_DAY = "CAST(date_diff('day', anchor_date, obs_date) AS INT)"


@query("window_join_closed", _BASE + """
SELECT a.loc_id, anchor_date, obs_date, param, CAST(value AS DOUBLE) AS value FROM anchors a JOIN obs o ON a.loc_id = o.loc_id
WHERE obs_date BETWEEN anchor_date - 3 AND anchor_date + 3""")
def window_join_closed(t: Tables) -> DataFrame:
    return window_join(anchors(t), observations(t), ["loc_id"], 3, 3).withColumn("value", F.col("value").cast("double"))


@query("window_join_half_open", _BASE + """
SELECT a.loc_id, anchor_date, obs_date, param, CAST(value AS DOUBLE) AS value FROM anchors a JOIN obs o ON a.loc_id = o.loc_id
WHERE obs_date >= anchor_date - 7 AND obs_date < anchor_date + 7""")
def window_join_half_open(t: Tables) -> DataFrame:
    return window_join(anchors(t), observations(t), ["loc_id"], 7, 7, "left").withColumn("value", F.col("value").cast("double"))


@query("same_day_join", _BASE + """
SELECT a.loc_id, anchor_date, param, CAST(value AS DOUBLE) AS value FROM anchors a JOIN obs o ON a.loc_id = o.loc_id AND obs_date = anchor_date""")
def same_day_join(t: Tables) -> DataFrame:
    """The [d, d + 1) window of hourly data."""
    out = window_join(anchors(t), observations(t), ["loc_id"], 0, 1, "left")
    return out.select("loc_id", "anchor_date", "param", F.col("value").cast("double").alias("value"))


@query("nearest_day_values", _BASE + f"""
SELECT loc_id, anchor_date, param, obs_date, CAST(value AS DOUBLE) AS value FROM (
  SELECT a.*, o.param, o.obs_date, o.value, row_number() OVER (PARTITION BY a.loc_id, anchor_date, param ORDER BY abs({_DAY}), obs_date) AS rn
  FROM anchors a JOIN obs o ON a.loc_id = o.loc_id AND obs_date BETWEEN anchor_date - 15 AND anchor_date + 15) WHERE rn = 1""")
def nearest_day_values(t: Tables) -> DataFrame:
    out = asof_nearest(anchors(t), observations(t), ["loc_id"], 15, ["value"], ["param"])
    return out.withColumn("value", F.col("value").cast("double"))


@query("earliest_day_values", _BASE + """
SELECT loc_id, anchor_date, param, obs_date, CAST(value AS DOUBLE) AS value FROM (
  SELECT a.*, o.param, o.obs_date, o.value, row_number() OVER (PARTITION BY a.loc_id, anchor_date, param ORDER BY obs_date) AS rn
  FROM anchors a JOIN obs o ON a.loc_id = o.loc_id AND obs_date >= anchor_date - 7 AND obs_date < anchor_date + 7) WHERE rn = 1""")
def earliest_day_values(t: Tables) -> DataFrame:
    out = asof_earliest(anchors(t), observations(t), ["loc_id"], 7, ["value"], ["param"])
    return out.withColumn("value", F.col("value").cast("double"))


_STATS = """CAST(sum(value) AS DOUBLE) / count(value) AS mean, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max, round(stddev_pop(value), 5) AS std"""


@query("window_statistics", _BASE + f"""
SELECT a.loc_id, anchor_date, param, {_STATS} FROM anchors a JOIN obs o ON a.loc_id = o.loc_id
WHERE obs_date BETWEEN anchor_date - 15 AND anchor_date + 15 GROUP BY ALL""")
def window_statistics(t: Tables) -> DataFrame:
    return window_stats(anchors(t), observations(t), ["loc_id"], 15).withColumn("std", F.round("std", 5))


@query("daily_mean_values", """
SELECT user_id AS loc_id, CAST(ts AS DATE) AS obs_date, event_type AS param, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS value FROM events GROUP BY ALL""")
def daily_mean_values(t: Tables) -> DataFrame:
    rows = t("events").select(
        F.col("user_id").alias("loc_id"), F.col("ts").cast("date").alias("obs_date"), F.col("event_type").alias("param"),
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    return daily_values(rows, ["loc_id", "param"], "obs_date")


@query("weather_window_features", _BASE + f""", w AS (
  SELECT a.loc_id, anchor_date, obs_date, param, value FROM anchors a JOIN obs o ON a.loc_id = o.loc_id AND obs_date BETWEEN anchor_date - 15 AND anchor_date + 15),
n AS (SELECT *, row_number() OVER (PARTITION BY loc_id, anchor_date, param ORDER BY abs({_DAY}), obs_date) AS rn FROM w),
s AS (SELECT loc_id, anchor_date, max(CASE WHEN param = 'view' THEN m END) AS view__mean, max(CASE WHEN param = 'view' THEN hi END) AS view__max,
  max(CASE WHEN param = 'click' THEN m END) AS click__mean, max(CASE WHEN param = 'click' THEN lo END) AS click__min FROM (
  SELECT loc_id, anchor_date, param, CAST(sum(value) AS DOUBLE) / count(value) AS m, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM w GROUP BY ALL) GROUP BY ALL)
SELECT s.*, d.view AS view_near, d.click AS click_near, round(d.view - d.click, 6) AS daily_range FROM s JOIN (
  SELECT loc_id, anchor_date, max(CASE WHEN param = 'view' THEN CAST(value AS DOUBLE) END) AS view, max(CASE WHEN param = 'click' THEN CAST(value AS DOUBLE) END) AS click
  FROM n WHERE rn = 1 GROUP BY ALL) d USING (loc_id, anchor_date)""")
def weather_window_features(t: Tables) -> DataFrame:
    """Statistics of the window, nearest-day values and their range: one join, one aggregate by (anchor, param), one pivot."""
    hits = window_join(anchors(t), observations(t), ["loc_id"], 15, 15)
    near = F.struct(F.abs(F.datediff("obs_date", "anchor_date")), F.col("obs_date"))
    stats = hits.groupBy("loc_id", "anchor_date", F.col("param").alias("variable")).agg(
        (F.sum("value").cast("double") / F.count("value")).alias("mean"), F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"), F.min_by("value", near).cast("double").alias("plain"),
    )
    wide = pivot_stats(stats, ["loc_id", "anchor_date"], ["view", "click"], ["mean", "min", "max", "plain"])
    return wide.select(
        "loc_id", "anchor_date", "view__mean", "view__max", "click__mean", "click__min", F.col("view").alias("view_near"),
        F.col("click").alias("click_near"), F.round(dtr(F.col("view"), F.col("click")), 6).alias("daily_range"),
    )


_ZEROED = "SELECT l_suppkey, l_linenumber, sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity AS DECIMAL(18,2)) END) AS v FROM lineitem GROUP BY ALL"


@query("suppress_optical_zero", f"SELECT l_suppkey, l_linenumber, CAST(v AS DOUBLE) AS mean, nullif(CAST(v AS DOUBLE), 0) AS plain FROM ({_ZEROED})")
def suppress_optical_zero(t: Tables) -> DataFrame:
    return suppress_zero(_zeroed(t), "optical")


@query("suppress_radar_zero", f"SELECT l_suppkey, l_linenumber, CAST(v AS DOUBLE) AS mean FROM ({_ZEROED}) WHERE v <> 0")
def suppress_radar_zero(t: Tables) -> DataFrame:
    return suppress_zero(_zeroed(t), "radar")


def _zeroed(t: Tables) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 2 == 0, F.lit(0)).otherwise(F.col("l_quantity")).cast("decimal(18,2)")
    return t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(value).cast("double").alias("mean"))


@query("suppress_terrain_zero", """
SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'aspect' ELSE 'slope' END AS variable, CASE WHEN l_returnflag = 'A' THEN NULL ELSE min(l_quantity) END AS min,
       nullif(max(l_linenumber)::DOUBLE - 7, 0) AS "stdDev" FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def suppress_terrain_zero(t: Tables) -> DataFrame:
    rows = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.min("l_quantity").alias("min"), (F.max("l_linenumber").cast("double") - 7).alias("stdDev")
    )
    named = rows.withColumn("variable", F.when(F.col("l_returnflag") == "A", F.lit("aspect")).otherwise(F.lit("slope")))
    return suppress_zero(named, "terrain").drop("l_returnflag")


# ---- merging --------------------------------------------------------------

_SIDES = """k AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(40000 + (o_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude,
  CAST(-5000 + o_custkey % 50 AS DOUBLE) / 1000 AS longitude, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
a AS (SELECT date, latitude, longitude, max(o_totalprice) AS price FROM k WHERE o_orderstatus <> 'F' GROUP BY ALL),
b AS (SELECT date, latitude, longitude, min(o_totalprice) AS price, min(o_orderkey) AS first_order FROM k WHERE o_orderstatus <> 'O' GROUP BY ALL),
c AS (SELECT date, latitude, longitude, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL)"""


def _keyed(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderdate").cast("date").alias("date"), latitude(F.col("o_custkey")).alias("latitude"), longitude(F.col("o_custkey")).alias("longitude"),
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
    )


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = _keyed(t)
    return (
        k.filter("o_orderstatus <> 'F'").groupBy(*KEYS).agg(F.max("o_totalprice").alias("price")),
        k.filter("o_orderstatus <> 'O'").groupBy(*KEYS).agg(F.min("o_totalprice").alias("price"), F.min("o_orderkey").alias("first_order")),
        k.groupBy(*KEYS).agg(F.count("*").alias("n")),
    )


@query("merge_two_sources", ctes(_SIDES) + "SELECT date, latitude, longitude, a.price, b.price AS price_s2, first_order FROM a FULL JOIN b USING (date, latitude, longitude)")
def merge_two_sources(t: Tables) -> DataFrame:
    a, b, _ = _sides(t)
    return merge_source(a, b, "_s2")


@query("assemble_master", ctes(_SIDES) + """
SELECT date, latitude, longitude, a.price, b.price AS price_s2, first_order, n FROM a FULL JOIN b USING (date, latitude, longitude) FULL JOIN c USING (date, latitude, longitude)""")
def assemble_master(t: Tables) -> DataFrame:
    a, b, c = _sides(t)
    return build_master([(a, ""), (b, "_s2"), (c, "_s1")], unique=True)


@query("attach_field_attributes", ctes(_SIDES) + """
SELECT c.*, m.area FROM c LEFT JOIN (SELECT date, latitude, longitude, arg_min(o_orderpriority, o_orderkey) AS area FROM k WHERE o_orderstatus = 'O' GROUP BY ALL) m
USING (date, latitude, longitude)""")
def attach_field_attributes(t: Tables) -> DataFrame:
    meta = _keyed(t).filter("o_orderstatus = 'O'").groupBy(*KEYS).agg(F.min_by("o_orderpriority", "o_orderkey").alias("area"))
    return attach_meta(_sides(t)[2], meta)


@query("plan_rows_per_location", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def plan_rows_per_location(t: Tables) -> DataFrame:
    """Row lookup by key with the salted join."""
    lines = t("lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return salted_join(lines, t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), ["l_orderkey"])
