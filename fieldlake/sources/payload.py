"""Landed daily weather payloads: nested JSON to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import WeatherConfig
from fieldlake.naming import col

PAYLOAD_SCHEMA = "struct<properties:struct<parameter:map<string,map<string,double>>>>"


def daily_observations(
    df: DataFrame, json_col: str, keys: list[str] | None = None, missing: float = WeatherConfig.missing_value
) -> DataFrame:
    """One row per (keys, date, param); the missing-value marker becomes null."""
    keys = ["latitude", "longitude"] if keys is None else keys
    payload = df.select(*map(col, keys), F.from_json(col(json_col), PAYLOAD_SCHEMA).alias("_p"))
    params = payload.select(*map(col, keys), F.explode("_p.properties.parameter").alias("param", "_days"))
    days = params.select(*map(col, keys), "param", F.explode("_days").alias("_day", "_v"))
    return days.select(
        *map(col, keys),
        F.try_to_timestamp("_day", F.lit("yyyyMMdd")).cast("date").alias("date"),
        "param",
        F.when(F.col("_v") != F.lit(float(missing)), F.col("_v")).alias("value"),
    )


def parse_daily_payload(
    df: DataFrame, json_col: str, params: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Wide form: one row per (keys, date) and one column per wanted parameter."""
    keys = ["latitude", "longitude"] if keys is None else keys
    long = daily_observations(df, json_col, keys).filter(F.col("param").isin(*params))
    return long.groupBy(*keys, "date").pivot("param", params).agg(F.max("value"))
