"""All sources to one wide table with a column manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.config import MasterConfig
from fieldlake.naming import FIELD_PREFIX, KEYS, col
from fieldlake.operators.joins import attach_meta, build_master
from fieldlake.operators.keyed import first_non_null, reorder_priority
from fieldlake.operators.profile import column_manifest
from fieldlake.plans.fetch import standardise
from fieldlake.plans.mapping import MAPPING_COLUMNS
from fieldlake.sources.tables import stage, write_table

# Stage order, manifest label and the suffix its clashing columns take.
STAGES = {
    "nasa_daily": "",
    "nasa_monthly": "_nasa_m",
    "sentinel2_modis": "_s2",
    "sentinel1": "_s1",
    "srtm": "_srtm",
    "era5_land": "_era5",
    "soilgrids": "_soil",
}


def field_meta(plan: DataFrame, cfg: MasterConfig = MasterConfig(), order: list[str] | None = None) -> DataFrame:
    """Field attributes per key, prefixed; the mapping columns are left out unless asked for."""
    own = [c for c in plan.columns if c not in KEYS and (cfg.include_mapping_columns or c not in MAPPING_COLUMNS)]
    named = {c: c if c.startswith(FIELD_PREFIX) else FIELD_PREFIX + c for c in own}
    ready = plan.select(*KEYS, *(col(c).alias(n) for c, n in named.items()))
    rounded = ready.withColumns({c: F.bround(c, 6) for c in ("latitude", "longitude")}).dropna(subset=KEYS)
    return first_non_null(rounded, KEYS, [named.get(c, c) for c in order or []])


def run_all(
    spark: SparkSession, plan: DataFrame, builders: dict[str, Callable[[], DataFrame]], out_dir: str,
    cfg: MasterConfig = MasterConfig(), suffix: str = "trial",
) -> tuple[DataFrame, DataFrame]:
    """(master, manifest), both also written under ``out_dir``.

    ``builders`` gives each stage by its label; a stage written before is read
    back, so a job that lost its driver goes on where it stopped.
    """
    frames = {
        label: stage(spark, f"{out_dir}/{label}_{suffix}", builders[label]) for label in STAGES if label in builders
    }
    master = build_master([(standardise(f, unique=True), STAGES[label]) for label, f in frames.items()], unique=True)
    meta = field_meta(plan, cfg)
    clashing = [c for c in meta.columns if c not in KEYS and c in master.columns]
    joined = reorder_priority(attach_meta(master, meta.drop(*clashing)), list(cfg.priority_columns), ["fp_Date of Harvest"])
    write_table(joined, f"{out_dir}/master", sort_by=KEYS)
    final = spark.read.parquet(f"{out_dir}/master")
    sources = {label: (f.columns, STAGES[label]) for label, f in frames.items()}
    sources["fetch_plan_meta"] = (meta.columns, "")
    manifest = column_manifest(final, sources, KEYS)
    write_table(manifest, f"{out_dir}/manifest")
    return final, spark.read.parquet(f"{out_dir}/manifest")
