"""The field table: dates, coordinates and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import WeatherConfig
from fieldlake.naming import KEYS, col, find_column, harvest_column
from fieldlake.operators.keyed import dedup_first
from fieldlake.sources.tables import clean_columns, nan_to_null

# Accepted date forms, day first.
DATE_FORMATS = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d")


def parse_date(text: Column) -> Column:
    """Day-first date; text in no known form gives null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS))


def number(text: Column) -> Column:
    """Double, or null when the text is not a finite number."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def coerce_coords(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Add numeric ``latitude``/``longitude`` and drop rows that lack either.

    A source column of the same name (in any case) is kept with the field prefix.
    """
    lat = lat or find_column(df.columns, "lat")
    lon = lon or find_column(df.columns, "lon")
    if lat is None or lon is None:
        raise ValueError("no latitude/longitude columns found")
    kept = [
        col(c).alias(f"fp_{c}") if c.lower() in ("latitude", "longitude") else col(c)
        for c in df.columns
    ]
    out = df.select(*kept, number(col(lat)).alias("latitude"), number(col(lon)).alias("longitude"))
    return out.dropna(subset=["latitude", "longitude"])


def valid_coords(df: DataFrame, cfg: WeatherConfig = WeatherConfig()) -> DataFrame:
    return df.filter(F.col("latitude").between(*cfg.lat_bounds) & F.col("longitude").between(*cfg.lon_bounds))


def calendar_window(df: DataFrame, months: int, mode: str = "last", date: str = "date") -> DataFrame:
    """Rows in the first or last N calendar months that occur in the data.

    The month list is one row per month; it joins as a semi join, so rows never move for a global rank.
    """
    month = F.trunc(col(date), "month")
    present = df.select(month.alias("_month")).dropna().distinct()
    order = F.col("_month").asc() if mode == "first" else F.col("_month").desc()
    kept = present.orderBy(order).limit(months)
    return df.withColumn("_month", month).join(kept, "_month", "left_semi").drop("_month")


def clean_fields(raw: DataFrame, order: list[str], months: int | None = None, mode: str = "last") -> DataFrame:
    """Raw field table to one row per (date, latitude, longitude), other columns kept.

    Text is cleaned and NaN becomes null; rows without readable coordinates go, and with ``months`` those without a date.
    ``order`` decides which row of a duplicate key is the first.
    """
    cleaned = clean_columns(nan_to_null(raw))
    harvest = harvest_column(cleaned.columns)
    if harvest is None:
        raise ValueError("no harvest date column found")
    dated = cleaned.withColumn("_date", parse_date(col(harvest)))
    if harvest.lower() == "date":
        dated = dated.drop(harvest)
    dated = coerce_coords(dated.withColumnRenamed("_date", "date"))
    if months:
        dated = calendar_window(dated, months, mode)
    return dedup_first(dated, KEYS, order)
