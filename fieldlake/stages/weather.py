"""Weather: value of the nearest day and window statistics per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.config import WeatherConfig
from fieldlake.functions.weather import DERIVED, add_derived
from fieldlake.naming import KEYS, col, stat_name
from fieldlake.operators.joins import nearest_rank, window_join
from fieldlake.operators.profile import drop_empty_std
from fieldlake.operators.zonal import STATS
from fieldlake.plans.fields import valid_coords
from fieldlake.plans.requests import source_rows, weather_requests
from fieldlake.session import cut_lineage, may_broadcast, shuffled
from fieldlake.stages.common import PLACE, requested_values

STAT_NAMES = ("mean", "min", "max", "std")


def with_derived(obs: DataFrame) -> DataFrame:
    """Observations plus rows of the derived variables, computed once per place and day."""
    inputs = sorted({p for names, _ in DERIVED.values() for p in names})
    wide = obs.filter(F.col("param").isin(*inputs)).groupBy(*PLACE, "date").agg(
        *(F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in inputs)
    )
    tall = add_derived(wide).unpivot([*PLACE, "date"], [col(n) for n in DERIVED], "param", "value")
    return obs.select(*PLACE, "date", "param", "value").unionByName(tall.filter(F.col("value").isNotNull()))


def _of_interest(obs: DataFrame, wanted: DataFrame, names: list[str], window_days: int) -> DataFrame:
    """Observations of the wanted parameters (and the inputs of derived ones), days and places.

    Parameters and the range of days are literals, so they reach the scan.
    """
    inputs = {p for n in names if n in DERIVED for p in DERIVED[n][0]}
    first, last = wanted.agg(F.min("anchor_date"), F.max("anchor_date")).first()
    near = obs.filter(F.col("param").isin(sorted({*names, *inputs})))
    if first is not None:
        days = F.make_interval(days=F.lit(window_days))
        near = near.filter(F.col("date").between((F.lit(first) - days).cast("date"), (F.lit(last) + days).cast("date")))
    places = wanted.select(*PLACE).distinct()
    return near.join(F.broadcast(places) if may_broadcast(places) else shuffled(places), PLACE, "left_semi")


def weather_stage(
    plan: DataFrame, obs: DataFrame, cfg: WeatherConfig = WeatherConfig(), params: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(daily, statistics) per (date, latitude, longitude).

    ``obs`` is (latitude, longitude, date, param, value), one row per place, day
    and parameter. ``daily`` holds the nearest day's values under the key's own date.
    """
    requests = weather_requests(valid_coords(source_rows(plan, "weather")))
    # One row per key, read by several jobs below: written once.
    wanted = cut_lineage(requests.select(
        col("date").alias("anchor_date"), *PLACE, F.array_union("params", "derived").alias("_names")
    ))
    names = params or requested_values(wanted, "_names")
    obs = _of_interest(obs, wanted, names, cfg.window_days)
    anchors = wanted.withColumn("param", F.explode("_names")).drop("_names")
    days = with_derived(obs).withColumnRenamed("date", "obs_date")
    hits = window_join(anchors, days, [*PLACE, "param"], cfg.window_days, cfg.window_days)
    # A key's group is bounded: window days x parameters.
    key = [*PLACE, "anchor_date"]
    near = nearest_rank(F.col("anchor_date"), F.col("obs_date"))
    marked = hits.withColumn("_best", near == F.min(near).over(Window.partitionBy(*key)))
    cells = []
    for p in names:
        mine = F.when(F.col("param") == p, F.col("value"))
        cells.append(F.max(F.when(F.col("_best"), mine)).alias(p))
        cells += [STATS[s](mine).alias(stat_name(p, s)) for s in STAT_NAMES]
    # The daily table and the statistics are two views of one result: written once.
    both = cut_lineage(marked.groupBy(*key).agg(*cells).withColumnRenamed("anchor_date", "date"))
    daily = both.select(*KEYS, *map(col, names))
    stats = both.select(*KEYS, *(col(stat_name(p, s)) for p in names for s in STAT_NAMES))
    return daily, drop_empty_std(stats)
