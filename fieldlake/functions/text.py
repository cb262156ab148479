"""Text cleaning and token functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space at either end of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Inner characters and what replaces them.
REPLACED = "\n\r\t\u2019\u2018\u2013\u2014"
REPLACEMENTS = "   ''--"

# Frequency words.
STATIC_WORDS = ("static", "once", "one-time", "0", "n/a")
DAILY_WORDS = ("daily", "daily/seasonal")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Trim, then turn line breaks, tabs, curly quotes and long dashes into plain characters."""
    return F.translate(trimmed(text), REPLACED, REPLACEMENTS)


def clean_frequency(text: Column) -> Column:
    """Days between observations: 0 for static data, null when unknown."""
    word = F.lower(clean_text(text))
    low = F.regexp_extract(word, r"(\d+)\s*(?:to|-)\s*(\d+)", 1)
    high = F.regexp_extract(word, r"(\d+)\s*(?:to|-)\s*(\d+)", 2)
    lead = F.regexp_extract(F.regexp_replace(word, "days|day|d|~", ""), r"^\s*(\d+)", 1)
    midpoint = F.bround((low.try_cast("int") + high.try_cast("int")) / F.lit(2.0), 0)
    return (
        F.when(word.isin(*STATIC_WORDS), F.lit(0))
        .when(word == "none", F.lit(None))
        .when(word.isin(*DAILY_WORDS), F.lit(1))
        .when(word == "weekly", F.lit(7))
        .when(low != "", midpoint.cast("int"))
        .when(lead != "", lead.try_cast("int"))
        .cast("int")
    )


def _pieces(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), trimmed)
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def split_list(text: Column) -> Column:
    """List text to tokens; commas, slashes, bars and semicolons all separate."""
    return _pieces(F.translate(text, "/|;()", ",,,  "))


def split_list_sar(text: Column) -> Column:
    """As :func:`split_list`, but a slash stays, so that 'VV/VH' is one token."""
    return _pieces(F.translate(text, "|;()", ",,  "))


def param_tokens(text: Column) -> Column:
    """Upper-case parameter names; the word DERIVED is not one."""
    tokens = F.transform(_pieces(F.translate(text, ";", ",")), F.upper)
    return F.filter(tokens, lambda t: t != "DERIVED")


def weather_var_key(name: Column) -> Column:
    """Canonical key of a weather variable's display name."""
    letters = F.regexp_replace(F.upper(name), "[^A-Z ]", "")
    key = F.trim(F.regexp_replace(letters, " +", " "))
    return (
        F.when(key.contains("DEW POINT"), F.lit("DEW POINT TEMPERATURE"))
        .when(key.contains("DIURNAL") | key.contains("DTR"), F.lit("DTR"))
        .when(key.contains("VPD"), F.lit("VPD"))
        .otherwise(key)
    )


def is_derived(text: Column) -> Column:
    """True only for the bare word 'derived'; null text is not."""
    return F.coalesce(F.lower(trimmed(text)) == "derived", F.lit(False))


def optical_token(token: Column) -> Column:
    """Name of the vegetation index a token asks for, else null."""
    t = F.lower(trimmed(token))
    return (
        F.when(t.isin("ndvi", "evi", "lai", "savi", "ndre"), F.upper(t))
        .when(t.isin("ci", "ci-rededge", "ci_rededge", "ciredge"), F.lit("CIredge"))
        .when(t.contains("chlorophyll") & t.contains("edge"), F.lit("CIredge"))
        .when(t.contains("red") & t.contains("edge") & t.contains("nd"), F.lit("NDRE"))
    )


def is_raw_band(token: Column) -> Column:
    return token.rlike(r"^[Bb]\d{1,2}[Aa]?$")


def product_of(dataset: Column) -> Column:
    """Optical product named by a dataset text; versions and suffixes are ignored."""
    t = F.lower(dataset)
    rule = F.when(t.contains("copernicus/s2") | t.contains("sentinel-2"), F.lit("S2"))
    for product in ("MOD13Q1", "MOD15A2H", "MOD16A2", "MOD17A2H"):
        rule = rule.when(t.contains(product.lower()), F.lit(product))
    return rule


def sar_token(token: Column) -> Column:
    """Radar group of a token: VV, VH, VVVH_ratio or RVI, else null."""
    t = F.translate(F.lower(trimmed(token)), " -_", "")
    vv, vh = t.contains("vv"), t.contains("vh")
    ratio = t.contains("ratio") | t.contains("/") | t.contains("over") | t.contains("div")
    return (
        F.when(ratio & vv & vh, F.lit("VVVH_ratio"))
        .when(t.contains("vvratio") | t.contains("vvvhlinear"), F.lit("VVVH_ratio"))
        .when(t.startswith("rvi") | t.contains("radarvegetationindex"), F.lit("RVI"))
        .when(t.startswith("vv") & ~vh & ~ratio, F.lit("VV"))
        .when(t.startswith("vh") & ~vv & ~ratio, F.lit("VH"))
    )


def terrain_token(token: Column) -> Column:
    """Terrain band of a token after taking off one statistic suffix, else null."""
    t = F.regexp_replace(F.translate(F.lower(trimmed(token)), " ", ""), "_(mean|min|max|stddev|std)$", "")
    return (
        F.when(t.isin("elev", "elevation"), F.lit("elevation"))
        .when(t.isin("slope", "aspect"), t)
        .when(t.isin("hillshade", "shade"), F.lit("hillshade"))
    )


def reanalysis_token(token: Column) -> Column:
    return F.translate(F.lower(trimmed(token)), "- ", "__")


def soil_token(token: Column) -> Column:
    """Soil band name; both misspellings of bulk density map to ``bdod``."""
    t = F.regexp_replace(F.lower(trimmed(token)), r"\s+", "_")
    return F.regexp_replace(t, "(bulk|balk)_", "bdod_")
