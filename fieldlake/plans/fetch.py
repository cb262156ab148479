"""The fetch plan: every field with every wanted variable."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import SoilConfig
from fieldlake.naming import KEYS, col
from fieldlake.operators.keyed import dedup_first
from fieldlake.plans.fields import number
from fieldlake.plans.mapping import MAPPING_COLUMNS, dedup_mapping

BLOCK_ROWS = 2000


def pair_with_mapping(fields: DataFrame, mapping: DataFrame, inline_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each field row with each mapping row, without a nested-loop join and without a shuffle.

    The mapping is taken in blocks of ``inline_rows``. Each block is an array literal that every field row explodes;
    the blocks' products are put side by side. A mapping is a list of variables that people keep, so its blocks
    travel inside the plan.
    """
    names, types = mapping.columns, dict(mapping.dtypes)
    plan = None
    rows = mapping.toLocalIterator()
    while block := list(itertools.islice(rows, inline_rows)):
        made = F.array(*(F.struct(*(F.lit(r[c]).cast(types[c]).alias(c) for c in names)) for r in block))
        packed = fields.select("*", F.explode(made).alias("_m"))
        part = packed.select(*(col(c) for c in fields.columns), *(F.col("_m")[c].alias(c) for c in names))
        plan = part if plan is None else plan.unionByName(part)
    return fields.select("*", *(F.lit(None).cast(types[c]).alias(c) for c in names)).limit(0) if plan is None else plan


def build_fetch_plan(fields: DataFrame, mapping: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Fields x mapping: keys, other field columns, mapping columns.

    Each side is made unique first. Their product is then unique on key and
    mapping columns, so the much larger product needs no shuffle of its own.
    """
    wanted = [c for c in MAPPING_COLUMNS if c in mapping.columns]
    single = dedup_first(fields, KEYS, order)
    others = [c for c in fields.columns if c not in KEYS]
    plan = pair_with_mapping(single, dedup_mapping(mapping.select(*map(col, wanted))))
    return plan.select(*KEYS, *map(col, others), *map(col, wanted))


def plan_summary(plan: DataFrame, fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: field keys, mapping rows, the product expected and the rows found."""
    wanted = [c for c in MAPPING_COLUMNS if c in mapping.columns]
    counts = [
        fields.select(*KEYS).distinct().agg(F.count("*").alias("n")).select(F.lit("n_fields").alias("k"), "n"),
        mapping.select(*map(col, wanted)).distinct().agg(F.count("*").alias("n")).select(F.lit("n_mapping").alias("k"), "n"),
        plan.agg(F.count("*").alias("n")).select(F.lit("n_plan").alias("k"), "n"),
    ]
    tall = counts[0].unionByName(counts[1]).unionByName(counts[2])
    row = tall.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("n_fields", "n_mapping", "n_plan")))
    expected = F.col("n_fields") * F.col("n_mapping")
    return row.withColumns({"n_expected": expected, "complete": expected == F.col("n_plan")})


# Source label, api text, variable text and id prefix of default plans.
DEFAULT_PLANS = {
    "s1": ("Sentinel-1", "Derived", "VV, VH, VV/VH ratio, RVI", "S1_Point_"),
    "srtm": ("SRTM", "Derived", "elevation, slope, aspect, hillshade", "SRTM_Point_"),
    "era5": ("ERA5", "total_precipitation,potential_evaporation,temperature_2m,skin_temperature", "", "ERA5_Point_"),
    "soil": ("SoilGrids", ",".join(SoilConfig.default_bands), "", "SoilGrids_Point_"),
}


def default_plan(coords: DataFrame, source: str, dates: list[str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Plan of a source for bare coordinates.

    ``ordinal`` counts the coordinates from 0; a shorter date list is used again
    from its start. Without dates every row is for today.
    """
    label, api, variable, prefix = DEFAULT_PLANS[source]
    if dates:
        days = F.array(*(F.lit(d) for d in dates))
        day = F.element_at(days, (F.pmod(col(ordinal), F.lit(len(dates))) + 1).cast("int")).cast("date")
    else:
        day = F.current_date()
    return coords.select(
        day.alias("date"), "latitude", "longitude",
        F.concat(F.lit(prefix), (col(ordinal) + 1).cast("string")).alias("location_id"),
        F.lit(variable).alias("variable"), F.lit(api).alias("api parameter"), F.lit(label).alias("source dataset"),
    )


def standardise(df: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None, unique: bool = False) -> DataFrame:
    """Date, six-digit coordinates, no null keys, one row per key.

    ``unique=True`` says the rows are known to be one per key (a grouped
    result), which saves the shuffle.
    """
    out = df.withColumnRenamed("month", "date") if "date" not in df.columns and "month" in df.columns else df
    if dict(out.dtypes)["date"] == "string":
        out = out.withColumn("date", F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    else:
        out = out.withColumn("date", col("date").cast("date"))
    text = {name for name, kind in out.dtypes if kind == "string"}
    rounded = {c: F.bround(number(col(c)) if c in text else col(c).cast("double"), 6) for c in ("latitude", "longitude")}
    out = out.withColumns(rounded).dropna(subset=keys)
    return out if unique else dedup_first(out, keys, order)
