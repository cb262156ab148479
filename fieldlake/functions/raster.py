"""Per-pixel optical and radar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes taken as cloud, shadow, cirrus, snow or water.
MASKED_SCENE_CLASSES = (3, 6, 8, 9, 10, 11)
REFLECTANCE_SCALE = 10000.0


def scl_clear(scene_class: Column) -> Column:
    """True when the pixel may be used; an unknown class is not clear."""
    return F.coalesce(~scene_class.isin(*MASKED_SCENE_CLASSES), F.lit(False))


def reflectance(digital_number: Column) -> Column:
    return digital_number / F.lit(REFLECTANCE_SCALE)


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndre(nir: Column, red_edge: Column) -> Column:
    return normalized_difference(nir, red_edge)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.lit(2.5) * F.try_divide(nir - red, nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0))


def lai(ndvi_value: Column) -> Column:
    return ndvi_value * F.lit(3.618) - F.lit(0.118)


def savi(nir: Column, red: Column) -> Column:
    return F.try_divide(F.lit(1.5) * (nir - red), nir + red + F.lit(0.5))


def ci_rededge(nir: Column, red_edge: Column) -> Column:
    return F.try_divide(nir, red_edge) - F.lit(1.0)


def optical_indexes(blue: Column, red: Column, red_edge: Column, nir: Column) -> dict[str, Column]:
    """All six indexes from digital numbers."""
    b, r, e, n = (reflectance(c) for c in (blue, red, red_edge, nir))
    return {
        "NDVI": ndvi(n, r),
        "EVI": evi(n, r, b),
        "LAI": lai(ndvi(n, r)),
        "SAVI": savi(n, r),
        "NDRE": ndre(n, e),
        "CIredge": ci_rededge(n, e),
    }


def vci(current: Column, low: Column, high: Column) -> Column:
    """Place of the current NDVI between the year's extremes; null when they are equal."""
    return F.try_divide(current - low, high - low)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(10.0))


def vv_vh_ratio_linear(vv_db: Column, vh_db: Column) -> Column:
    return F.try_divide(db_to_linear(vv_db), db_to_linear(vh_db))


def rvi(vv_db: Column, vh_db: Column) -> Column:
    vv, vh = db_to_linear(vv_db), db_to_linear(vh_db)
    return F.try_divide(F.lit(4.0) * vh, vv + vh)
