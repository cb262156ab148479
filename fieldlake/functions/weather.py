"""Derived weather variables: T in degrees C, RH in percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.naming import col

# Magnus constants.
MAGNUS_A = 17.27
MAGNUS_B = 237.7


def dtr(t_max: Column, t_min: Column) -> Column:
    return t_max - t_min


def dew_point(t: Column, rh: Column) -> Column:
    """Magnus dew point; null at RH = 0."""
    gamma = F.try_divide(F.lit(MAGNUS_A) * t, F.lit(MAGNUS_B) + t) + F.ln(rh / F.lit(100.0))
    return F.try_divide(F.lit(MAGNUS_B) * gamma, F.lit(MAGNUS_A) - gamma)


def vpd(t: Column, rh: Column) -> Column:
    saturation = F.lit(0.6108) * F.exp(F.try_divide(F.lit(17.27) * t, t + F.lit(237.3)))
    return saturation * (F.lit(1.0) - rh / F.lit(100.0))


# name -> (input parameters, formula)
DERIVED = {
    "DTR": (("T2M_MAX", "T2M_MIN"), dtr),
    "VPD": (("T2M", "RH2M"), vpd),
    "DEW POINT TEMPERATURE": (("T2M", "RH2M"), dew_point),
}


def add_derived(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Add each wanted derived variable whose input columns all exist."""
    present = set(df.columns)
    added = {}
    for name in wanted if wanted is not None else DERIVED:
        inputs, formula = DERIVED.get(name, ((), None))
        if formula is not None and present.issuperset(inputs):
            added[name] = formula(*(col(c) for c in inputs))
    return df.withColumns(added) if added else df
