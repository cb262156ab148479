"""The table of wanted variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.text import clean_frequency
from fieldlake.naming import col
from fieldlake.sources.tables import clean_columns

MAPPING_COLUMNS = ["variable", "api parameter", "source dataset", "dataset", "frequency", "detailed_notes"]

# Accepted headers and their standard names.
HEADER_NAMES = {
    "Key Variable": "variable",
    "Variable": "variable",
    "API Parameter": "api parameter",
    "API": "api parameter",
    "Band": "api parameter",
    "Source Dataset": "source dataset",
    "Dataset (GEE/NASA/Other)": "dataset",
    "Frequency": "frequency",
    "Detailed Notes (Calculation / Derivation)": "detailed_notes",
    "Detailed Notes": "detailed_notes",
}


def normalise_mapping(df: DataFrame) -> DataFrame:
    """Standard header; standard columns that are absent are added as null text."""
    out = df.withColumnsRenamed({old: new for old, new in HEADER_NAMES.items() if old in df.columns})
    absent = [c for c in MAPPING_COLUMNS if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else out


def dedup_mapping(df: DataFrame) -> DataFrame:
    return df.dropDuplicates([c for c in MAPPING_COLUMNS if c in df.columns])


def clean_mapping(raw: DataFrame) -> DataFrame:
    """Clean text, standard header, frequency in days, duplicates removed."""
    named = normalise_mapping(clean_columns(raw))
    return dedup_mapping(named.withColumn("frequency", clean_frequency(col("frequency"))))
