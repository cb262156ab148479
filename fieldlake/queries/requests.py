"""Token parsing, routing and per-key requests over the whole fetch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import text as T
from fieldlake.naming import KEYS, col
from fieldlake.plans.fetch import build_fetch_plan
from fieldlake.plans.requests import (
    match_bands, optical_requests, plan_audit, reanalysis_requests, route_sources, sar_requests, sar_stat_keys, soil_requests,
    source_rows, terrain_requests, wants_vci, weather_requests, work_list,
)
from fieldlake.queries.base import FIELDS_SQL, MAPPING_SQL, Tables, ctes, mapping_frame, query, raw_fields
from fieldlake.sources.scenes import available_bands, resolve_bands

# A third of the plan rows has no api text, so that keys differ in what they ask for.
_GAPPY_SQL = """plan AS (
  SELECT f.date, f.latitude, f.longitude, f.field_id, "variable", "source dataset", lower("source dataset") AS src,
         CASE WHEN (field_id + length("variable")) % 3 = 0 THEN NULL ELSE "api parameter" END AS api
  FROM fields f CROSS JOIN mapping m)"""
_PLAN = ctes(FIELDS_SQL, MAPPING_SQL, _GAPPY_SQL)
_KEY = "date, latitude, longitude"


def gappy_plan(t: Tables) -> DataFrame:
    plan = build_fetch_plan(raw_fields(t), mapping_frame(t.spark), ["field_id"])
    known = (F.col("field_id") + F.length("variable")) % 3 != 0
    return plan.withColumn("api parameter", F.when(known, F.col("api parameter")))


def _list_sql(text: str, marks: str = "/|;()", into: str = ",,,  ") -> str:
    return f"list_filter(list_transform(string_split(translate({text}, '{marks}', '{into}'), ','), lambda t: trim(t)), lambda t: t <> '')"


_SAR_LIST = lambda x: _list_sql(x, "|;()", ",,  ")
_ROUTES = {
    "weather": "src LIKE '%nasa%'",
    "optical": "regexp_matches(src, 'modis|copernicus/s2|sentinel-2')",
    "radar": "(regexp_matches(src, 'copernicus/s1|sentinel-1|sentinel1|s1_grd|s1|sar|radar|c-band')"
             " OR regexp_matches(lower(\"variable\"), 's1|sentinel.?1|radar|sar|vv|vh'))",
    "terrain": "src LIKE '%srtm%'",
    "reanalysis": "src LIKE '%era5%'",
    "soil": "regexp_matches(src, 'soilgrids|isric')",
}
_HITS = "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in _ROUTES.items()) + "], lambda s: s IS NOT NULL)"


def _text(name: str):
    return F.array_join(col(name), ",").alias(name)


# ---- tokens ---------------------------------------------------------------

_WORDS = "SELECT p_partkey, p_name || ';' || p_brand || ' , derived,, (' || p_type || ')/' || p_size AS s FROM part"


def _words(t: Tables) -> DataFrame:
    s = F.concat(F.col("p_name"), F.lit(";"), F.col("p_brand"), F.lit(" , derived,, ("), F.col("p_type"), F.lit(")/"), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", s.alias("s"))


@query("parameter_tokens", f"""SELECT p_partkey, array_to_string(list_filter(list_transform({_list_sql('s', ';', ',')}, lambda t: upper(t)), lambda t: t <> 'DERIVED'), '|') AS tokens
FROM ({_WORDS})""")
def parameter_tokens(t: Tables) -> DataFrame:
    return _words(t).select("p_partkey", F.array_join(T.param_tokens(F.col("s")), "|").alias("tokens"))


@query("list_tokens", f"SELECT p_partkey, array_to_string({_list_sql('s')}, '#') AS tokens FROM ({_WORDS})")
def list_tokens(t: Tables) -> DataFrame:
    return _words(t).select("p_partkey", F.array_join(T.split_list(F.col("s")), "#").alias("tokens"))


@query("list_tokens_keeping_slash", f"SELECT p_partkey, array_to_string({_SAR_LIST('s')}, '#') AS tokens FROM ({_WORDS})")
def list_tokens_keeping_slash(t: Tables) -> DataFrame:
    return _words(t).select("p_partkey", F.array_join(T.split_list_sar(F.col("s")), "#").alias("tokens"))


_KEYED = "trim(regexp_replace(regexp_replace(upper(x), '[^A-Z ]', '', 'g'), ' +', ' ', 'g'))"


@query("weather_variable_keys", f"""
SELECT p_partkey, CASE WHEN k LIKE '%DEW POINT%' THEN 'DEW POINT TEMPERATURE' WHEN k LIKE '%DIURNAL%' OR k LIKE '%DTR%' THEN 'DTR'
       WHEN k LIKE '%VPD%' THEN 'VPD' ELSE k END AS key
FROM (SELECT p_partkey, {_KEYED} AS k FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' dew  point (2m)' WHEN 1 THEN ' Diurnal-range'
      WHEN 2 THEN ' vpd' WHEN 3 THEN '_9  x' ELSE '' END AS x FROM part))""")
def weather_variable_keys(t: Tables) -> DataFrame:
    tails = F.array(*map(F.lit, (" dew  point (2m)", " Diurnal-range", " vpd", "_9  x", "")))
    text = F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 5 + 1).cast("int")))
    return t("part").select("p_partkey", T.weather_var_key(text).alias("key"))


# Token spellings tried on every part row; the part's size is added to make them vary.
_SPELLINGS = ["ndvi", " EVI", "CI-rededge", "chlorophyll Edge", "red edge ND", "VV/VH ratio", "vv_mean", "VH max", "RVI index", "radar vegetation-index",
              "VVVH linear", "elev_mean", "Slope stddev", "hill shade_max", "aspect", "total-precipitation", "skin temperature", "bulk_0-5cm mean", "balk 5cm", "x"]
_SPELLED = "SELECT p_partkey, CASE p_partkey % {} {} END || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' END AS x FROM part".format(
    len(_SPELLINGS), " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SPELLINGS)))


def _spelled(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("p_partkey") % len(_SPELLINGS) + 1).cast("int"))
    return t("part").select("p_partkey", F.concat(word, F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.lit(" "))).alias("x"))


_OPTICAL = """CASE WHEN {0} IN ('ndvi', 'evi', 'lai', 'savi', 'ndre') THEN upper({0}) WHEN {0} IN ('ci', 'ci-rededge', 'ci_rededge', 'ciredge') THEN 'CIredge'
  WHEN {0} LIKE '%chlorophyll%' AND {0} LIKE '%edge%' THEN 'CIredge' WHEN {0} LIKE '%red%' AND {0} LIKE '%edge%' AND {0} LIKE '%nd%' THEN 'NDRE' END"""
_RATIO = "({0} LIKE '%ratio%' OR {0} LIKE '%/%' OR {0} LIKE '%over%' OR {0} LIKE '%div%')"
_SAR = f"""CASE WHEN {_RATIO} AND {{0}} LIKE '%vv%' AND {{0}} LIKE '%vh%' THEN 'VVVH_ratio'
  WHEN {{0}} LIKE '%vvratio%' OR {{0}} LIKE '%vvvhlinear%' THEN 'VVVH_ratio' WHEN {{0}} LIKE 'rvi%' OR {{0}} LIKE '%radarvegetationindex%' THEN 'RVI'
  WHEN {{0}} LIKE 'vv%' AND {{0}} NOT LIKE '%vh%' AND NOT {_RATIO} THEN 'VV' WHEN {{0}} LIKE 'vh%' AND {{0}} NOT LIKE '%vv%' AND NOT {_RATIO} THEN 'VH' END"""
_TERRAIN = "CASE {0} WHEN 'elev' THEN 'elevation' WHEN 'elevation' THEN 'elevation' WHEN 'slope' THEN 'slope' WHEN 'aspect' THEN 'aspect' WHEN 'hillshade' THEN 'hillshade' WHEN 'shade' THEN 'hillshade' END"
_SQUEEZED = "translate(lower(trim({})), ' -_', '')"
_STEM = "regexp_replace(replace(lower(trim({})), ' ', ''), '_(mean|min|max|stddev|std)$', '')"


@query("band_tokens", f"""
SELECT p_partkey, {_OPTICAL.format('lower(trim(x))')} AS optical, {_SAR.format(_SQUEEZED.format('x'))} AS sar, {_TERRAIN.format(_STEM.format('x'))} AS terrain,
       translate(lower(trim(x)), '- ', '__') AS reanalysis, regexp_replace(regexp_replace(lower(trim(x)), '\\s+', '_', 'g'), '(bulk|balk)_', 'bdod_', 'g') AS soil
FROM ({_SPELLED})""")
def band_tokens(t: Tables) -> DataFrame:
    x = F.col("x")
    return _spelled(t).select(
        "p_partkey", T.optical_token(x).alias("optical"), T.sar_token(x).alias("sar"), T.terrain_token(x).alias("terrain"),
        T.reanalysis_token(x).alias("reanalysis"), T.soil_token(x).alias("soil"),
    )


@query("optical_products", _PLAN + """
SELECT field_id, "variable", CASE WHEN src LIKE '%copernicus/s2%' OR src LIKE '%sentinel-2%' THEN 'S2' WHEN src LIKE '%mod13q1%' THEN 'MOD13Q1'
  WHEN src LIKE '%mod15a2h%' THEN 'MOD15A2H' WHEN src LIKE '%mod16a2%' THEN 'MOD16A2' WHEN src LIKE '%mod17a2h%' THEN 'MOD17A2H' END AS product FROM plan""")
def optical_products(t: Tables) -> DataFrame:
    return gappy_plan(t).select("field_id", "variable", T.product_of(F.col("source dataset")).alias("product"))


# ---- routing --------------------------------------------------------------

@query("route_plan_rows", _PLAN + f'SELECT field_id, "variable", unnest({_HITS}) AS source FROM plan')
def route_plan_rows(t: Tables) -> DataFrame:
    return route_sources(gappy_plan(t)).select("field_id", "variable", "source")


@query("audit_plan_sources", _PLAN + f""", hits AS (SELECT src, {_HITS} AS h FROM plan)
SELECT source, count(*) AS n_rows, CAST(sum(shared) AS BIGINT) AS n_shared, array_to_string(list_sort(list(DISTINCT src)), ',') AS datasets FROM (
  SELECT src, (len(h) > 1)::INT AS shared, unnest(CASE WHEN len(h) > 0 THEN h ELSE ['unmatched'] END) AS source FROM hits) GROUP BY source""")
def audit_plan_sources(t: Tables) -> DataFrame:
    return plan_audit(gappy_plan(t)).withColumn("datasets", F.array_join("datasets", ","))


@query("radar_work_list", _PLAN + f"SELECT DISTINCT {_KEY} FROM plan WHERE {_ROUTES['radar']}")
def radar_work_list(t: Tables) -> DataFrame:
    return work_list(gappy_plan(t), "radar")


# ---- requests -------------------------------------------------------------

_VARKEY = _KEYED.replace("(x)", '("variable")')
_DERIVED = f"""CASE WHEN {_VARKEY} LIKE '%DEW POINT%' THEN 'DEW POINT TEMPERATURE' WHEN {_VARKEY} LIKE '%DIURNAL%' OR {_VARKEY} LIKE '%DTR%' THEN 'DTR'
  WHEN {_VARKEY} LIKE '%VPD%' THEN 'VPD' END"""


@query("weather_requests", _PLAN + f""", r AS (SELECT {_KEY}, {_DERIVED} AS d, {_list_sql('api', ';', ',')} AS a FROM plan WHERE {_ROUTES['weather']}),
p AS (SELECT {_KEY}, upper(unnest(a)) AS p FROM r UNION SELECT {_KEY}, unnest(CASE d WHEN 'DTR' THEN ['T2M_MAX', 'T2M_MIN'] ELSE ['T2M', 'RH2M'] END) FROM r WHERE d IS NOT NULL),
g AS (SELECT {_KEY}, string_agg(DISTINCT p, ',' ORDER BY p) AS params FROM p WHERE p <> 'DERIVED' GROUP BY ALL)
SELECT g.*, coalesce(d.derived, '') AS derived FROM g LEFT JOIN (SELECT {_KEY}, string_agg(DISTINCT d, ',' ORDER BY d) AS derived FROM r WHERE d IS NOT NULL GROUP BY ALL) d USING ({_KEY})""")
def weather_request_sets(t: Tables) -> DataFrame:
    return weather_requests(source_rows(gappy_plan(t), "weather")).select(*KEYS, _text("params"), _text("derived"))


_SIX = "['NDVI', 'EVI', 'LAI', 'SAVI', 'NDRE', 'CIredge']"


@query("optical_requests", _PLAN + f""", r AS (SELECT {_KEY}, coalesce(api, '') LIKE '%erived%' AS every, list_concat({_list_sql("coalesce(api, '')")}, {_list_sql('"variable"')}) AS t
  FROM plan WHERE {_ROUTES['optical']} AND (src LIKE '%sentinel-2%' OR src LIKE '%copernicus/s2%')),
k AS (SELECT {_KEY}, bool_or(every) AS every FROM r GROUP BY ALL), u AS (SELECT {_KEY}, unnest(t) AS t FROM r),
raw AS (SELECT {_KEY}, string_agg(DISTINCT t, ',' ORDER BY t) FILTER (WHERE length(t) = 2) AS r2, string_agg(DISTINCT t, ',' ORDER BY t) FILTER (WHERE length(t) = 3) AS r3
  FROM u WHERE regexp_full_match(t, '[Bb][0-9]{{1,2}}[Aa]?') GROUP BY ALL),
der AS (SELECT {_KEY}, list(DISTINCT {_OPTICAL.format('lower(t)')}) AS d FROM u WHERE NOT regexp_full_match(t, '[Bb][0-9]{{1,2}}[Aa]?') AND {_OPTICAL.format('lower(t)')} IS NOT NULL GROUP BY ALL)
SELECT k.date, k.latitude, k.longitude, concat_ws(',', r2, r3) AS raw,
  array_to_string(list_filter({_SIX}, lambda b: CASE WHEN every AND d IS NULL THEN true ELSE coalesce(list_contains(d, b), false) END), ',') AS derived
FROM k LEFT JOIN raw USING ({_KEY}) LEFT JOIN der USING ({_KEY})""")
def optical_request_sets(t: Tables) -> DataFrame:
    rows = source_rows(gappy_plan(t), "optical").filter(T.product_of(F.col("source dataset")) == "S2")
    return optical_requests(rows).select(*KEYS, _text("raw"), _text("derived"))


@query("condition_index_requests", _PLAN + f"""
SELECT {_KEY}, bool_or((lower(coalesce(api, '')) = 'derived' AND (lower("variable") LIKE '%vci%' OR lower("variable") LIKE '%vegetation condition%'))
  OR list_contains({_list_sql("lower(coalesce(api, ''))")}, 'vci')) AS wants_vci FROM plan WHERE src LIKE '%mod13q1%' GROUP BY ALL""")
def condition_index_requests(t: Tables) -> DataFrame:
    return wants_vci(gappy_plan(t).filter(T.product_of(F.col("source dataset")) == "MOD13Q1"))


def _sets_sql(route: str, token: str, splitter) -> str:
    """Per key: whether any row is derived, and token sets from both texts."""
    return _PLAN + f""", r AS (SELECT * FROM plan WHERE {route}),
k AS (SELECT {_KEY}, bool_or(lower(trim(coalesce(api, ''))) = 'derived') AS der FROM r GROUP BY ALL),
v AS (SELECT {_KEY}, list_sort(list(DISTINCT g)) AS s FROM (SELECT {_KEY}, {token} AS g FROM (SELECT {_KEY}, unnest({splitter('"variable"')}) AS t FROM r)) WHERE g IS NOT NULL GROUP BY ALL),
a AS (SELECT {_KEY}, list_sort(list(DISTINCT g)) AS s FROM (SELECT {_KEY}, {token} AS g FROM (SELECT {_KEY}, unnest({splitter('api')}) AS t FROM r)) WHERE g IS NOT NULL GROUP BY ALL),
s AS (SELECT k.*, v.s AS vs, a.s AS ap FROM k LEFT JOIN v USING ({_KEY}) LEFT JOIN a USING ({_KEY}))
"""


_GROUPS = """list_sort(list_distinct(CASE WHEN der AND vs IS NOT NULL THEN list_concat(vs, ['VV', 'VH']) WHEN der THEN ['VV', 'VH', 'VVVH_ratio', 'RVI']
  WHEN ap IS NOT NULL THEN ap WHEN vs IS NOT NULL THEN vs ELSE ['VV', 'VH', 'VVVH_ratio', 'RVI'] END))"""
_SAR_SETS = _sets_sql(_ROUTES["radar"], _SAR.format(_SQUEEZED.format("t")), _SAR_LIST)


@query("radar_requests", _SAR_SETS + f"SELECT {_KEY}, array_to_string({_GROUPS}, ',') AS groups FROM s")
def radar_request_sets(t: Tables) -> DataFrame:
    return sar_requests(source_rows(gappy_plan(t), "radar")).select(*KEYS, _text("groups"))


@query("radar_stat_columns", _SAR_SETS + f""", g AS (SELECT {_KEY}, {_GROUPS} AS gs FROM s)
SELECT {_KEY}, CASE WHEN list_contains(gs, 'VVVH_ratio') OR list_contains(gs, 'RVI') THEN 'VV,VH' ELSE array_to_string(list_filter(['VV', 'VH'], lambda b: list_contains(gs, b)), ',') END AS bands,
  array_to_string(flatten(list_transform(gs, lambda g: [g || '__mean', g || '__stdDev', g || '__min', g || '__max'])), ',') AS stat_keys FROM g""")
def radar_stat_columns(t: Tables) -> DataFrame:
    return sar_stat_keys(sar_requests(source_rows(gappy_plan(t), "radar"))).select(*KEYS, _text("bands"), _text("stat_keys"))


@query("terrain_requests", _sets_sql(_ROUTES["terrain"], _TERRAIN.format(_STEM.format("t")), _list_sql) + f"""
SELECT {_KEY}, array_to_string(list_filter(['elevation', 'slope', 'aspect', 'hillshade'],
  lambda b: CASE WHEN (CASE WHEN der THEN vs ELSE ap END) IS NULL THEN true ELSE list_contains(CASE WHEN der THEN vs ELSE ap END, b) END), ',') AS bands FROM s""")
def terrain_request_sets(t: Tables) -> DataFrame:
    return terrain_requests(source_rows(gappy_plan(t), "terrain")).select(*KEYS, _text("bands"))


@query("reanalysis_requests", _PLAN + f""", r AS (SELECT {_KEY}, coalesce(api, '') <> '' AND lower(api) <> 'derived' AS named, lower("variable") = 'irrigation' AS irr, api FROM plan WHERE {_ROUTES['reanalysis']}),
b AS (SELECT {_KEY}, translate(lower(unnest({_list_sql('api')})), '- ', '__') AS b FROM r WHERE named
  UNION SELECT {_KEY}, unnest(['total_precipitation', 'potential_evaporation']) FROM r WHERE NOT named AND irr)
SELECT {_KEY}, bands, irrigation FROM (SELECT {_KEY}, string_agg(DISTINCT b, ',' ORDER BY b) AS bands FROM b GROUP BY ALL)
JOIN (SELECT {_KEY}, bool_or(NOT named AND irr) AS irrigation FROM r GROUP BY ALL) USING ({_KEY})""")
def reanalysis_request_sets(t: Tables) -> DataFrame:
    return reanalysis_requests(source_rows(gappy_plan(t), "reanalysis")).select(*KEYS, _text("bands"), "irrigation")


_SOIL = f"""SELECT *, split_part(band, '_', 1) AS prefix FROM (SELECT {_KEY}, regexp_replace(regexp_replace(lower(t), '\\s+', '_', 'g'), '(bulk|balk)_', 'bdod_', 'g') AS band
  FROM (SELECT {_KEY}, unnest({_list_sql('api')}) AS t FROM plan WHERE {_ROUTES['soil']})) WHERE band LIKE '%\\_%' ESCAPE '\\'
  AND split_part(band, '_', 1) IN ('ocd', 'phh2o', 'sand', 'silt', 'clay', 'nitrogen', 'cec', 'cfvo', 'bdod')"""


@query("soil_requests", _PLAN + f"SELECT {_KEY}, prefix, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM ({_SOIL}) GROUP BY ALL")
def soil_request_sets(t: Tables) -> DataFrame:
    return soil_requests(source_rows(gappy_plan(t), "soil")).select(*KEYS, "prefix", _text("bands"))


@query("match_requested_bands", """
WITH r AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN lower(o_orderstatus) WHEN 1 THEN o_orderstatus ELSE 'zz' END AS token FROM orders),
b AS (SELECT DISTINCT l_returnflag AS band FROM lineitem UNION SELECT DISTINCT l_linestatus FROM lineitem)
SELECT r.*, band FROM r JOIN b ON lower(r.token) = lower(b.band)""")
def match_requested_bands(t: Tables) -> DataFrame:
    token = F.when(F.col("o_custkey") % 3 == 0, F.lower("o_orderstatus")).when(F.col("o_custkey") % 3 == 1, F.col("o_orderstatus")).otherwise(F.lit("zz"))
    lines = t("lineitem")
    bands = lines.select(F.col("l_returnflag").alias("band")).distinct().union(lines.select("l_linestatus").distinct()).distinct()
    return match_bands(t("orders").select("o_orderkey", token.alias("token")), bands)


def _band_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    requests = t("orders").select(F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("band"), "o_orderkey")
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    present = available_bands(lines.filter("l_quantity > 20").select(F.col("o_orderpriority").alias("product"), F.col("l_linestatus").alias("band")))
    return resolve_bands(requests, present)


_AVAILABLE = """WITH r AS (SELECT o_orderpriority AS product, o_orderstatus AS band, o_orderkey FROM orders),
b AS (SELECT DISTINCT o_orderpriority AS product, l_linestatus AS band FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 20)
"""


@query("available_band_requests", _AVAILABLE + "SELECT r.* FROM r SEMI JOIN b USING (product, band)")
def available_band_requests(t: Tables) -> DataFrame:
    return _band_sides(t)[0]


@query("dropped_band_requests", _AVAILABLE + "SELECT r.* FROM r ANTI JOIN b USING (product, band)")
def dropped_band_requests(t: Tables) -> DataFrame:
    return _band_sides(t)[1]
