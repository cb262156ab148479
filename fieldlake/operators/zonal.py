"""Window statistics, zonal statistics and composites.

Results stay long, (keys, variable, statistics), until the sink pivots them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.naming import col, stat_name
from fieldlake.operators.joins import window_join
from fieldlake.session import shuffled

STATS = {
    "mean": lambda v: F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double")),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "stdDev": F.stddev_pop,
}


def stat_aggs(value: Column, stats: list[str]) -> list[Column]:
    return [STATS[s](value).cast("double").alias(s) for s in stats]


def daily_values(obs: DataFrame, keys: list[str], date: str, value: str = "value") -> DataFrame:
    """One mean value per (keys, day): an upper bound of one row per key and day for every later join."""
    return obs.groupBy(*map(col, keys), col(date)).agg(STATS["mean"](col(value)).alias(value))


def window_stats(
    anchors: DataFrame, obs: DataFrame, on: list[str], days: int, param: str = "param", value: str = "value",
    stats: tuple[str, ...] = ("mean", "min", "max", "std"), anchor_date: str = "anchor_date", obs_date: str = "obs_date",
) -> DataFrame:
    """Mean, min, max and population deviation of each parameter in ``[anchor - days, anchor + days]``.

    ``obs`` has one row per (location, day, parameter). Nulls are skipped; a
    parameter without any value in the window gives no row.
    """
    joined = window_join(anchors, obs.filter(col(value).isNotNull()), on, days, days, "both", anchor_date, obs_date)
    return joined.groupBy(*map(col, anchors.columns), col(param)).agg(*stat_aggs(col(value), list(stats)))


def zonal_stats(
    pixels: DataFrame, by: list[str], stats: tuple[str, ...] = ("mean", "min", "max"), value: str = "value"
) -> DataFrame:
    """Statistics of a region's pixels, one row per ``by`` (keys and band)."""
    return pixels.filter(col(value).isNotNull()).groupBy(*map(col, by)).agg(*stat_aggs(col(value), list(stats)))


def median_composite(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Exact median over the scenes of a window, per region pixel and band.

    The group is one pixel's scenes inside one window, so it stays small.
    """
    return pixels.groupBy(*map(col, by)).agg(F.percentile(col(value), F.lit(0.5)).alias(value))


def daily_reduce(
    pixels: DataFrame, by: list[str], sum_bands: tuple[str, ...], band: str = "band", value: str = "value"
) -> DataFrame:
    """Hourly to daily: sum for the given bands, mean for all others. ``by`` holds the day and the band."""
    total, mean = F.sum(col(value)).cast("double"), STATS["mean"](col(value))
    return pixels.groupBy(*map(col, by)).agg(F.when(col(band).isin(*sum_bands), total).otherwise(mean).alias(value))


def year_extremes(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Smallest and largest value of each pixel over the rows of ``by`` (pixel and year)."""
    return pixels.groupBy(*map(col, by)).agg(F.min(col(value)).alias("low"), F.max(col(value)).alias("high"))


def vci_by_region(extremes: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """(current - low) / (high - low), with low and high averaged over the region; null when equal.

    ``extremes`` has one row per region pixel and year; ``current`` has the column
    ``current`` and any key columns besides ``by``.
    """
    region = extremes.groupBy(*map(col, by)).agg(
        STATS["mean"](col("low")).alias("low"), STATS["mean"](col("high")).alias("high")
    )
    span = col("high") - col("low")
    ratio = F.when(span != 0, (col("current") - col("low")) / span)
    keys = [c for c in current.columns if c != "current"]
    return shuffled(current).join(region, by).select(*map(col, keys), ratio.alias("VCI")).filter(col("VCI").isNotNull())


def suppress_zero(stats: DataFrame, rule: str, variable: str = "variable") -> DataFrame:
    """Zero handling of a source on long statistics.

    ``optical``: adds the plain value, null when the mean is 0. ``radar``: every
    zero becomes null and rows left empty go. ``terrain``: a zero deviation and
    the minimum aspect become null.
    """
    def nonzero(name: str) -> Column:
        return F.nullif(col(name), F.lit(0.0))

    if rule == "optical":
        return stats.withColumn("plain", nonzero("mean"))
    names = [c for c in ("mean", "min", "max", "std", "stdDev") if c in stats.columns]
    if rule == "radar":
        cleaned = stats.withColumns({c: nonzero(c) for c in names})
        return cleaned.filter(F.coalesce(*map(col, names)).isNotNull())
    if rule == "terrain":
        cleaned = stats.withColumns({c: nonzero(c) for c in names if c in ("std", "stdDev")})
        return cleaned.withColumn("min", F.when(col(variable) != "aspect", col("min")))
    raise ValueError(f"unknown rule {rule!r}")


def pivot_stats(
    stats: DataFrame, keys: list[str], variables: list[str], names: list[str], variable: str = "variable"
) -> DataFrame:
    """Long statistics to ``<variable>__<stat>`` columns; the 'plain' statistic takes the bare name.

    One conditional aggregate over an explicit list: no job to discover values, one shuffle.
    """
    def out_name(v: str, s: str) -> str:
        return v if s == "plain" else stat_name(v, s)

    cells = [F.max(F.when(col(variable) == v, col(s))).alias(out_name(v, s)) for v in variables for s in names]
    return stats.filter(col(variable).isin(*variables)).groupBy(*map(col, keys)).agg(*cells)
