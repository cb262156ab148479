import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from fieldlake.stages import radar_stage, reanalysis_stage, soil_stage

SOURCES = {"soil": ("SoilGrids", "clay_0-5cm_mean; sand_0-5cm_mean"), "reanalysis": ("ERA5-Land", "total_precipitation"), "radar": ("Sentinel-1", "VV, VH")}


def plan_rows(spark, source):
    dataset, api = SOURCES[source]
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 50).cast("int"))
    return spark.range(300).select(
        day.alias("date"), (F.lit(40.0) + (F.col("id") % 7) / 100).alias("latitude"), F.lit(-5.0).alias("longitude"),
        F.lit("x").alias("variable"), F.lit(api).alias("api parameter"), F.lit(dataset).alias("source dataset"),
    ).distinct()


def pixels(spark, bands):
    spots = spark.range(200).select(
        F.lit(0).alias("px_row"), F.col("id").alias("px_col"), (F.lit(40.0) + (F.col("id") % 70) / 1000).alias("lat"), F.lit(-5.0).alias("lon"), (F.col("id") % 9 - 20).cast("double").alias("value"))
    return spots.withColumn("band", F.explode(F.array(*map(F.lit, bands))))


@pytest.mark.parametrize("source", sorted(SOURCES))
def test_keys_are_not_broadcast(spark, source):
    """A table of keys packs so well that its file says nothing of its rows: no join may take it to the driver."""
    plan = plan_rows(spark, source)
    if source == "soil":
        out = soil_stage(plan, pixels(spark, ["clay_0-5cm_mean", "sand_0-5cm_mean"]))
    elif source == "reanalysis":
        hours = F.explode(F.array(*(F.lit(dt.datetime(2020, 1, d, 5)) for d in (3, 9)))).alias("ts")
        out = reanalysis_stage(plan, pixels(spark, ["total_precipitation"]).select("*", hours))
    else:
        scene = spark.createDataFrame([("s", "S1", dt.datetime(2020, 1, 20), 0.0, "IW", ["VV", "VH"], 10)], "scene_id string, product string, scene_ts timestamp, cloud_pct double, instrument_mode string, polarisations array<string>, resolution_m int")
        out = radar_stage(plan, scene, pixels(spark, ["VV", "VH"]).select("*", F.lit("s").alias("scene_id"), F.lit("S1").alias("product")))
    assert out.count() > 0
    steps = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[(\w+\()*(date|anchor_date|latitude)#", steps)
