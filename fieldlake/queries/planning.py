"""Scans, cleaning, fetch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.text import clean_frequency, clean_text
from fieldlake.naming import KEYS, col
from fieldlake.operators.keyed import (
    collapse_duplicates, dedup_first, drop_all_zero, first_non_null, interpolate_linear, reorder_priority, stats_view, top_k,
    union_stages,
)
from fieldlake.operators.profile import drop_sparse_columns
from fieldlake.operators.prep import prepare_model_input
from fieldlake.plans.fetch import build_fetch_plan, default_plan, plan_summary, standardise
from fieldlake.plans.fields import calendar_window, clean_fields, coerce_coords, parse_date, valid_coords
from fieldlake.plans.mapping import MAPPING_COLUMNS, clean_mapping, dedup_mapping, normalise_mapping
from fieldlake.queries.base import (
    ANCHORS_SQL, FIELDS_SQL, MAPPING_SQL, OBS_SQL, PLAN_SQL, Tables, anchors, ctes, latitude, longitude, mapping_frame,
    observations, query, raw_fields,
)
from fieldlake.sources.payload import daily_observations, parse_daily_payload
from fieldlake.sources.tables import clean_columns

# Blanks as SQL text, for the cleaning checks.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
_CLEAN = f"translate(trim({{}}, {_BLANKS}), chr(10) || chr(13) || chr(9) || chr(8217) || chr(8216) || chr(8211) || chr(8212), '   ''''--')"


@query("clean_documents_text", f"SELECT doc_id, {_CLEAN.format('text')} AS text, {_CLEAN.format('lang')} AS lang FROM documents")
def clean_documents_text(t: Tables) -> DataFrame:
    return clean_columns(t("documents").select("doc_id", "text", "lang"))


@query("clean_marked_text", f"""
SELECT doc_id, {_CLEAN.format("chr(160) || chr(9) || text || chr(8217) || chr(8211) || 'x' || chr(10)")} AS text FROM documents""")
def clean_marked_text(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("\xa0\t"), F.col("text"), F.lit("’–x\n"))
    return t("documents").select("doc_id", clean_text(marked).alias("text"))


@query("table_rows_by_language", """
SELECT lang, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS chars, min(source) AS first_source FROM documents GROUP BY lang""")
def table_rows_by_language(t: Tables) -> DataFrame:
    return t("documents").groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.sum("n_chars").alias("chars"), F.min("source").alias("first_source")
    )


@query("parse_event_payload", """
SELECT event_id, CAST(ts AS DATE) AS date, nullif(k, 69) AS k FROM (
  SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL""")
def parse_event_payload(t: Tables) -> DataFrame:
    """The event's own JSON laid out as a daily payload; 69 plays the missing marker."""
    day = F.date_format("ts", "yyyyMMdd")
    payload = F.concat(F.lit('{"properties":{"parameter":{"k":{"'), day, F.lit('":'), F.get_json_object("props", "$.k"), F.lit("}}}}"))
    rows = daily_observations(t("events").select("event_id", payload.alias("payload")), "payload", ["event_id"], missing=69)
    return rows.select("event_id", "date", F.col("value").alias("k"))


@query("payload_to_wide_params", """
SELECT user_id, CAST(ts AS DATE) AS date, max(CASE WHEN event_type = 'click' THEN v END) AS click,
       max(CASE WHEN event_type = 'view' THEN v END) AS "view"
FROM (SELECT user_id, ts, event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events)
WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def payload_to_wide_params(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, F.lit("-999")).otherwise(F.col("value").cast("string"))
    payload = F.concat(
        F.lit('{"properties":{"parameter":{"'), F.col("event_type"), F.lit('":{"'), F.date_format("ts", "yyyyMMdd"),
        F.lit('":'), value, F.lit("}}}}"),
    )
    rows = t("events").select("user_id", payload.alias("payload"))
    return parse_daily_payload(rows, "payload", ["click", "view"], ["user_id"])


@query("parse_harvest_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""")
def parse_harvest_dates(t: Tables) -> DataFrame:
    forms = [F.date_format("o_orderdate", f) for f in ("dd-MM-yyyy", "yyyy-MM-dd", "d/M/yyyy", "dd.MM.yyyy")]
    form = F.col("o_orderkey") % 5
    text = F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).when(form == 3, forms[3]).otherwise(F.lit("31-02-x"))
    return t("orders").select("o_orderkey", parse_date(text).alias("date"))


@query("coerce_coordinates", """
SELECT c_custkey, c_acctbal / 100 AS latitude, CAST(c_nationkey * 10 AS DOUBLE) AS longitude
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0""")
def coerce_coordinates(t: Tables) -> DataFrame:
    rows = t("customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), (F.col("c_acctbal") / 100).cast("string"))).alias("lat_text"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise((F.col("c_nationkey") * 10).cast("string")).alias("lon_text"),
    )
    return coerce_coords(rows).select("c_custkey", "latitude", "longitude")


@query("valid_coordinates", """
SELECT c_custkey, c_acctbal / 50 AS latitude, CAST(c_nationkey * 10 AS DOUBLE) AS longitude FROM customer
WHERE c_acctbal / 50 BETWEEN -90 AND 90 AND c_nationkey * 10 BETWEEN -180 AND 180""")
def valid_coordinates(t: Tables) -> DataFrame:
    return valid_coords(t("customer").select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("latitude"), (F.col("c_nationkey") * 10).cast("double").alias("longitude")
    ))


def _months_sql(order: str) -> str:
    return f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM (
  SELECT *, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate) {order}) AS r FROM orders) WHERE r <= 3"""


@query("last_calendar_months", _months_sql("DESC"))
def last_calendar_months(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return calendar_window(rows, 3, "last")


@query("first_calendar_months", _months_sql("ASC"))
def first_calendar_months(t: Tables) -> DataFrame:
    rows = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return calendar_window(rows, 3, "first")


@query("dedup_fields", ctes(FIELDS_SQL) + "SELECT * FROM fields")
def dedup_fields(t: Tables) -> DataFrame:
    return dedup_first(raw_fields(t), KEYS, ["field_id"])


@query("clean_field_table", """
WITH raw AS (SELECT o_orderkey AS field_id, '''' || o_orderpriority || '''' AS area, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS crop_yield, CAST(o_orderdate AS DATE) AS date,
  CAST(40000 + (o_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude, CAST(-5000 + o_custkey % 50 AS DOUBLE) / 1000 AS longitude FROM orders WHERE o_orderkey % 31 <> 0 AND o_custkey % 29 <> 0),
kept AS (SELECT *, dense_rank() OVER (ORDER BY date_trunc('month', date) DESC) AS m, row_number() OVER (PARTITION BY date, latitude, longitude ORDER BY field_id) AS n FROM raw)
SELECT date, latitude, longitude, field_id, area, crop_yield FROM kept WHERE m <= 24 AND n = 1""")
def clean_field_table(t: Tables) -> DataFrame:
    """A field table as people keep it: dates in several forms or none, coordinates as text, curly quotes, NaN."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = t("orders").select(
        key.alias("field_id"), F.concat(F.lit(" \u2018"), "o_orderpriority", F.lit("\u2019\n")).alias("area"),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("crop_yield"),
        F.when(key % 31 == 0, F.lit("unknown")).when(key % 2 == 0, F.date_format(day, "d/M/yyyy")).otherwise(F.concat(day.cast("string"), F.lit(" "))).alias("Harvest Date"),
        F.when(F.col("o_custkey") % 29 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), latitude(F.col("o_custkey")).cast("string"))).alias("Latitude"),
        longitude(F.col("o_custkey")).cast("string").alias("Longitude"),
    )
    return clean_fields(rows, ["field_id"], 24).select("date", "latitude", "longitude", "field_id", "area", "crop_yield")


@query("dedup_hot_status", """
SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_hot_status(t: Tables) -> DataFrame:
    """Three keys hold all rows: the case partial aggregation is for."""
    rows = t("orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    return dedup_first(rows, ["o_orderstatus"], ["o_totalprice", "o_orderkey"])


@query("normalise_mapping_headers", ctes(MAPPING_SQL) + """
SELECT p_partkey, trim("variable") AS variable, "api parameter" AS "api parameter", CAST(NULL AS VARCHAR) AS "source dataset",
       dataset, CAST(NULL AS VARCHAR) AS frequency, detailed_notes
FROM part JOIN (SELECT *, row_number() OVER (ORDER BY "variable", "api parameter") - 1 AS i FROM mapping) ON p_partkey % 24 = i""")
def normalise_mapping_headers(t: Tables) -> DataFrame:
    names = sorted((r for r in mapping_frame(t.spark).collect()), key=lambda r: (r["variable"], r["api parameter"]))
    pick = lambda n: F.element_at(F.array(*(F.lit(r[n]) for r in names)), (F.col("p_partkey") % 24 + 1).cast("int"))
    raw = t("part").select(
        "p_partkey", pick("variable").alias("Key Variable"), pick("api parameter").alias("Band"),
        pick("dataset").alias("Dataset (GEE/NASA/Other)"), pick("detailed_notes").alias("Detailed Notes"),
    )
    return normalise_mapping(clean_columns(raw)).select("p_partkey", *map(col, MAPPING_COLUMNS))


_FREQ = """CASE
  WHEN w IN ('static', 'once', 'one-time', '0', 'n/a') THEN 0 WHEN w = 'none' THEN NULL
  WHEN w IN ('daily', 'daily/seasonal') THEN 1 WHEN w = 'weekly' THEN 7
  WHEN regexp_matches(w, '[0-9]+\\s*(to|-)\\s*[0-9]+') THEN CAST(round_even(
    (CAST(regexp_extract(w, '([0-9]+)\\s*(to|-)\\s*([0-9]+)', 1) AS INT) + CAST(regexp_extract(w, '([0-9]+)\\s*(to|-)\\s*([0-9]+)', 3) AS INT)) / 2.0, 0) AS INT)
  ELSE TRY_CAST(regexp_extract(regexp_replace(w, 'days|day|d|~', '', 'g'), '^\\s*([0-9]+)', 1) AS INT) END"""
_FREQ_FORMS = ["Static", "daily", "none", "5 to 10 days", "~{} days", "{}-{} d", "Weekly", "{}d", "every {}", "{} – 17"]


@query("clean_frequency_days", "SELECT p_partkey, " + _FREQ + """ AS days FROM (
  SELECT p_partkey, lower(replace(CASE p_partkey % 10 WHEN 0 THEN 'Static' WHEN 1 THEN 'daily' WHEN 2 THEN 'none' WHEN 3 THEN '5 to 10 days'
    WHEN 4 THEN '~' || p_size || ' days' WHEN 5 THEN p_size || '-' || (p_size + 3) || ' d' WHEN 6 THEN 'Weekly' WHEN 7 THEN p_size || 'd'
    WHEN 8 THEN 'every ' || p_size ELSE p_size || ' ' || chr(8211) || ' 17' END, chr(8211), '-')) AS w FROM part)""")
def clean_frequency_days(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = [
        F.lit("Static"), F.lit("daily"), F.lit("none"), F.lit("5 to 10 days"), F.concat(F.lit("~"), size, F.lit(" days")),
        F.concat(size, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(" d")), F.lit("Weekly"), F.concat(size, F.lit("d")),
        F.concat(F.lit("every "), size), F.concat(size, F.lit(" – 17")),
    ]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t("part").select("p_partkey", clean_frequency(text).alias("days"))


@query("dedup_mapping_rows", """
SELECT DISTINCT p_name AS variable, p_brand AS "api parameter", p_type AS "source dataset", 'x' AS dataset, p_size AS frequency,
       CAST(NULL AS VARCHAR) AS detailed_notes FROM part""")
def dedup_mapping_rows(t: Tables) -> DataFrame:
    return dedup_mapping(t("part").select(
        F.col("p_name").alias("variable"), F.col("p_brand").alias("api parameter"), F.col("p_type").alias("source dataset"),
        F.lit("x").alias("dataset"), F.col("p_size").alias("frequency"), F.lit(None).cast("string").alias("detailed_notes"),
    ))


_PLAN = ctes(FIELDS_SQL, MAPPING_SQL, PLAN_SQL)


@query("build_fetch_plan", _PLAN + """
SELECT date, latitude, longitude, field_id, area, season, crop_yield, variable, "api parameter", "source dataset", dataset, frequency, detailed_notes
FROM plan""")
def fetch_plan(t: Tables) -> DataFrame:
    return build_fetch_plan(raw_fields(t), mapping_frame(t.spark), ["field_id"])


@query("plan_cardinality", _PLAN + """
SELECT *, n_fields * n_mapping AS n_expected, n_fields * n_mapping = n_plan AS complete FROM (
  SELECT (SELECT count(*) FROM fields) AS n_fields, (SELECT count(*) FROM mapping) AS n_mapping, (SELECT count(*) FROM plan) AS n_plan)""")
def plan_cardinality(t: Tables) -> DataFrame:
    fields, mapping = raw_fields(t), clean_mapping(mapping_frame(t.spark))
    return plan_summary(build_fetch_plan(fields, mapping, ["field_id"]), fields, mapping)


@query("default_radar_plan", """
SELECT CASE c_custkey % 3 WHEN 0 THEN DATE '2020-07-15' WHEN 1 THEN DATE '2019-07-15' ELSE DATE '2018-07-15' END AS date,
       CAST(40000 + (c_custkey * 7) % 1000 AS DOUBLE) / 1000 AS latitude, CAST(-5000 + c_custkey % 50 AS DOUBLE) / 1000 AS longitude,
       'S1_Point_' || (c_custkey + 1) AS location_id, 'VV, VH, VV/VH ratio, RVI' AS variable, 'Derived' AS "api parameter",
       'Sentinel-1' AS "source dataset" FROM customer""")
def default_radar_plan(t: Tables) -> DataFrame:
    return default_plan(_coords(t), "s1", ["2020-07-15", "2019-07-15", "2018-07-15"])


def _coords(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t("customer").select(key.alias("ordinal"), latitude(key).alias("latitude"), longitude(key).alias("longitude"))


@query("default_ground_plans", """
SELECT label AS "source dataset", count(*) AS n_rows, count(DISTINCT location_id) AS n_places, min(api) AS api, min(variable) AS variable FROM (
  SELECT label, prefix || (c_custkey + 1) AS location_id, api, variable FROM customer CROSS JOIN (VALUES
    ('SRTM', 'SRTM_Point_', 'Derived', 'elevation, slope, aspect, hillshade'),
    ('ERA5', 'ERA5_Point_', 'total_precipitation,potential_evaporation,temperature_2m,skin_temperature', ''),
    ('SoilGrids', 'SoilGrids_Point_', 'bdod_0-5cm_mean,clay_0-5cm_mean,sand_0-5cm_mean,silt_0-5cm_mean,ocd_0-5cm_mean,phh2o_0-5cm_mean,nitrogen_0-5cm_mean,cec_0-5cm_mean,cfvo_0-5cm_mean', '')
  ) v(label, prefix, api, variable)) GROUP BY label""")
def default_ground_plans(t: Tables) -> DataFrame:
    plans = union_stages([default_plan(_coords(t), s, ["2020-07-15"]) for s in ("srtm", "era5", "soil")])
    return plans.groupBy("source dataset").agg(
        F.count("*").alias("n_rows"), F.countDistinct("location_id").alias("n_places"), F.min("api parameter").alias("api"), F.min("variable").alias("variable")
    )


@query("reorder_columns", """
SELECT o_totalprice AS "fp_yield (kg / ha)", o_orderpriority AS "fp_Area", o_orderkey AS row_id FROM orders""")
def reorder_columns(t: Tables) -> DataFrame:
    rows = t("orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("fp_Date of Harvest"),
        F.col("o_orderpriority").alias("fp_Area"), F.col("o_totalprice").alias("fp_yield (kg / ha)"),
    )
    return reorder_priority(rows, ["fp_yield (kg / ha)", "fp_Area"], ["fp_Date of Harvest"])


@query("standardise_keys", """
SELECT date, latitude, longitude, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY date, latitude, longitude ORDER BY o_orderkey) AS rn FROM (
    SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 40 AS DOUBLE) AS latitude,
           CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS DOUBLE) END AS longitude, o_orderkey FROM orders)
  WHERE longitude IS NOT NULL) WHERE rn = 1""")
def standardise_keys(t: Tables) -> DataFrame:
    rows = t("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("month"),
        ((F.col("o_custkey") % 40) + F.lit(0.0000001)).alias("latitude"),
        F.when(F.col("o_orderkey") % 19 != 0, (F.col("o_custkey") % 3).cast("string")).alias("longitude"), "o_orderkey",
    )
    return standardise(rows, order=["o_orderkey"])


@query("drop_zero_rows", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT (l_discount = 0 AND (l_tax = 0 OR l_orderkey % 5 = 0))""")
def drop_zero_rows(t: Tables) -> DataFrame:
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("a__mean"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("a__max"), "l_tax",
    )
    return drop_all_zero(rows).select("l_orderkey", "l_linenumber", F.col("a__mean").alias("l_discount"), "l_tax")


@query("statistics_view", """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS DOUBLE) AS latitude, 0.0::DOUBLE AS longitude, min(o_totalprice) AS price__min,
       max(o_totalprice) AS price__max FROM orders GROUP BY ALL""")
def statistics_view(t: Tables) -> DataFrame:
    rows = t("orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude")
    ).agg(F.min("o_totalprice").alias("price__min"), F.max("o_totalprice").alias("price__max"), F.count("*").alias("n"))
    return stats_view(rows)


@query("drop_sparse_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS tenth, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS kept
FROM orders""")
def sparse_columns(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t("orders").select(
        "o_orderkey", F.when(o % 10 != 0, F.col("o_totalprice")).alias("tenth"), F.when(o % 2 != 0, F.col("o_custkey")).alias("kept"),
        F.when(o % 3 == 0, F.col("o_custkey")).alias("sparse"),
    )
    return drop_sparse_columns(rows, 0.2, ["kept"])[0]


@query("model_input_cleanup", """
SELECT o_orderkey + 9007199254740993 AS row_id, CAST(o_totalprice AS FLOAT) AS "ET", o_orderpriority AS "fp_Area",
       CASE WHEN dayofyear(o_orderdate) = 365 THEN CAST(0 AS FLOAT) ELSE round(CAST(sin(6.283185307179586 * dayofyear(o_orderdate) / 365) AS FLOAT), 5) END AS doy_sin FROM orders""")
def model_input_cleanup(t: Tables) -> DataFrame:
    rows = t("orders").select(
        (F.col("o_orderkey") + 9007199254740993).alias("row_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("ET"),
        F.col("o_totalprice").alias("ET__mean"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(0.0).alias("slope__min"),
        F.col("o_orderpriority").alias("fp_Area"),
    )
    return prepare_model_input(rows).withColumn("doy_sin", F.round("doy_sin", 5))


@query("first_non_null_by_nation", """
SELECT c_nationkey, arg_min(c_acctbal, c_custkey) FILTER (WHERE c_custkey % 3 <> 0) AS bal,
       arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_custkey % 4 = 0) AS segment FROM customer GROUP BY 1""")
def first_non_null_by_nation(t: Tables) -> DataFrame:
    rows = t("customer").select(
        "c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("segment"),
    )
    return first_non_null(rows, ["c_nationkey"], ["c_custkey"])


@query("collapse_duplicate_keys", """
SELECT o_custkey, a, b, price FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, price DESC) AS rn FROM (
    SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS b,
           o_totalprice AS price FROM orders)) WHERE rn = 1""")
def collapse_duplicate_keys(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t("orders").select("o_custkey", F.col("o_totalprice").alias("price"), F.when(o % 2 == 0, o).alias("a"), F.when(o % 3 == 0, o).alias("b"))
    return collapse_duplicates(rows, ["o_custkey"])


@query("interpolate_daily_gaps", ctes(OBS_SQL, """
days AS (SELECT loc_id, param, obs_date, CASE WHEN (loc_id + day(obs_date)) % 3 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS v,
                row_number() OVER (PARTITION BY loc_id, param ORDER BY obs_date) AS i FROM obs)""", """
near AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY loc_id, param ORDER BY i) AS lo,
                   min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY loc_id, param ORDER BY i DESC) AS hi FROM days)""") + """
SELECT n.loc_id, n.param, n.obs_date, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN n.lo IS NULL THEN h.v WHEN n.hi IS NULL THEN l.v
       ELSE l.v + (h.v - l.v) / (n.hi - n.lo) * (n.i - n.lo) END, 7) AS v
FROM near n LEFT JOIN days l ON l.loc_id = n.loc_id AND l.param = n.param AND l.i = n.lo
LEFT JOIN days h ON h.loc_id = n.loc_id AND h.param = n.param AND h.i = n.hi""")
def interpolate_daily_gaps(t: Tables) -> DataFrame:
    """All parameters; a history is cut into slices of a week, so that values are carried across them."""
    gap = (F.col("loc_id") + F.dayofmonth("obs_date")) % 3 == 0
    days = observations(t).select("loc_id", "param", "obs_date", F.when(~gap, F.col("value").cast("double")).alias("v"))
    week = F.floor(F.unix_date("obs_date") / 7)
    return interpolate_linear(days, ["v"], ["loc_id", "param"], ["obs_date"], week).withColumn("v", F.round("v", 7))


@query("union_differing_frames", """
SELECT o_orderkey AS id, o_totalprice AS a, CAST(NULL AS DOUBLE) AS b FROM orders UNION ALL
SELECT c_custkey, NULL, c_acctbal FROM customer""")
def union_differing_frames(t: Tables) -> DataFrame:
    return union_stages([
        t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a")),
        t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b")),
    ])


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(t: Tables) -> DataFrame:
    return top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("sorted_field_keys", ctes(ANCHORS_SQL) + "SELECT loc_id, anchor_date FROM anchors ORDER BY 1, 2")
def sorted_field_keys(t: Tables) -> DataFrame:
    return anchors(t).orderBy("loc_id", "anchor_date")
