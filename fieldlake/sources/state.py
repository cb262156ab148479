"""Fitted state: one small parameter table per step, stored as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlake.sources.tables import read_table, write_table


def save_state(state: dict[str, DataFrame], path: str) -> None:
    """Write each parameter table under ``path/<name>``."""
    for name, table in state.items():
        write_table(table, f"{path.rstrip('/')}/{name}")


def load_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{path.rstrip('/')}/{name}") for name in names}
