"""Column naming rules and name discovery."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ["date", "latitude", "longitude"]
FIELD_PREFIX = "fp_"

# Stat names join with two underscores: T2M__max must not clash with T2M_MAX,
# because column names are case-insensitive.
STAT_SEP = "__"
STAT_SUFFIX = re.compile(r"__(mean|min|max|std|stdDev)$")


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def stat_name(variable: str, stat: str) -> str:
    return f"{variable}{STAT_SEP}{stat}"


def find_column(columns: Iterable[str], *parts: str) -> str | None:
    """First column whose lower-case name holds every part."""
    for name in columns:
        lowered = name.strip().lower()
        if all(part in lowered for part in parts):
            return name
    return None


def named(columns: Iterable[str], wanted: str) -> str | None:
    """Column with this name, ignoring case and outer blanks."""
    return next((c for c in columns if c.strip().lower() == wanted.lower()), None)


def harvest_column(columns: Iterable[str]) -> str | None:
    """The harvest-date column: 'date' and 'harvest' in the name, else plain 'date'."""
    columns = list(columns)
    return find_column(columns, "date", "harvest") or named(columns, "date")


def dataset_column(columns: Iterable[str]) -> str:
    """'source dataset' when present, else 'dataset'."""
    columns = list(columns)
    found = named(columns, "source dataset") or named(columns, "dataset")
    if found is None:
        raise ValueError("the plan needs a 'source dataset' or 'dataset' column")
    return found


def matching(columns: Iterable[str], *parts: str) -> list[str]:
    """Columns whose name holds any of the parts (case as given)."""
    return [c for c in columns if any(p in c for p in parts)]
