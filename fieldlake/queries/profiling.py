"""Table reports, distributions, metrics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.operators.metrics import psi, psi_reference, quality_score, regression_metrics
from fieldlake.operators.order import average_rank, column_quantiles, grouped_quantiles, unpivot
from fieldlake.operators.profile import (
    NORMAL_COEFFICIENTS, box_stats, column_manifest, corr_matrix, data_profile, drop_empty_std, family_profile, histogram, missing_by_group,
    missing_report, qq_points, report_rows, residuals, target_corr, target_stats,
)
from fieldlake.queries.base import MODEL_SQL, Tables, ctes, model_rows, query

_M = ctes(MODEL_SQL)
_X = ("x1", "x2", "x3", "x4")


def _per_column(select: str, columns=_X) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {select.format(c)} FROM model" for c in columns)


_GAPS = _per_column("count(*) - count({0}) AS missing, CAST(count(*) - count({0}) AS DOUBLE) / count(*) * 100 AS pct", ("row_id", "target", "season", "area", *_X))


@query("missing_report", _M + _GAPS)
def missing_by_column(t: Tables) -> DataFrame:
    return missing_report(model_rows(t))


@query("missing_top_columns", _M + f"SELECT * FROM ({_GAPS}) WHERE missing > 0 ORDER BY pct DESC, feature LIMIT 2")
def missing_top_columns(t: Tables) -> DataFrame:
    return missing_report(model_rows(t), top=2)


@query("missing_by_season", _M + " UNION ALL ".join(
    f"SELECT season, '{c}' AS feature, CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS pct FROM model GROUP BY season" for c in _X))
def missing_by_season(t: Tables) -> DataFrame:
    return missing_by_group(model_rows(t), "season", list(_X))


@query("target_summary", _M + """SELECT count(*) AS n, round(avg(target), 4) AS mean, round(stddev_samp(target), 4) AS std, min(target) AS min, max(target) AS max,
  round(skewness(target), 6) AS skewness, round(kurtosis(target), 6) AS kurtosis,
  round(exp(-(count(*) / 6.0::DOUBLE * (pow(g1, 2) + pow(g2, 2) / 4)) / 2), 9) AS jarque_bera_p
FROM model, (SELECT avg(pow(target - m, 3)) / pow(avg(pow(target - m, 2)), 1.5) AS g1, avg(pow(target - m, 4)) / pow(avg(pow(target - m, 2)), 2) - 3 AS g2
  FROM model, (SELECT avg(target) AS m FROM model)) GROUP BY g1, g2""")
def target_summary(t: Tables) -> DataFrame:
    places = {"mean": 4, "std": 4, "skewness": 6, "kurtosis": 6, "jarque_bera_p": 9}
    return target_stats(model_rows(t), "target").withColumns({c: F.round(c, n) for c, n in places.items()})


@query("correlation_pairs", _M + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM model" for i, a in enumerate(_X) for b in _X[i + 1:]))
def correlation_pairs(t: Tables) -> DataFrame:
    return corr_matrix(model_rows(t), list(_X)).withColumn("r", F.round("r", 6))


_WIDE = [f"d{i}" for i in range(18)]
_WIDE_SQL = "w AS (SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + {i}) % {7 + i} = 0 THEN NULL ELSE (l_quantity * {i + 1} + l_partkey * {i % 5}) % {31 + i} END AS d{i}" for i in range(18)) + " FROM lineitem)"


@query("correlation_many_columns", ctes(_WIDE_SQL) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM w" for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:]))
def correlation_many_columns(t: Tables) -> DataFrame:
    """Over 120 pairs: per-task matrix products, then sums."""
    o, q, p = F.col("l_orderkey"), F.col("l_quantity"), F.col("l_partkey")
    wide = t("lineitem").select(*(F.when((o + i) % (7 + i) != 0, (q * (i + 1) + p * (i % 5)) % (31 + i)).alias(c) for i, c in enumerate(_WIDE)))
    return corr_matrix(wide, _WIDE).withColumn("r", F.round("r", 6))


@query("target_correlations", _M + "SELECT feature, round(abs_r, 6) AS abs_r FROM (" + _per_column("abs(corr({0}, target)) AS abs_r") + ") ORDER BY 2 DESC LIMIT 3")
def target_correlations(t: Tables) -> DataFrame:
    return target_corr(model_rows(t), "target", list(_X), 3).withColumn("abs_r", F.round("abs_r", 6))


_FAMILY_COLUMNS = {
    "T2M__mean": "l_quantity", "NDVI__mean": "CASE WHEN l_linenumber <> 1 THEN l_tax END", "VV__mean": "CASE WHEN l_linenumber < 5 THEN l_discount END",
    "sand_0-5cm_mean": "l_extendedprice", "slope__mean": "CASE WHEN l_orderkey % 2 = 0 THEN l_tax END", "soil_water_layer": "l_tax",
}


_FAMILY_OF = {
    "T2M__mean": "Meteorology", "NDVI__mean": "Vegetation", "VV__mean": "SAR", "sand_0-5cm_mean": "Soil", "slope__mean": "Topography", "soil_water_layer": "Climate",
}
_FAMILY_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{fam}' AS family, CAST(count(*) - count(\"{c}\") AS DOUBLE) / count(*) * 100 AS pct FROM w" for c, fam in _FAMILY_OF.items()
)


@query("family_profile", "WITH w AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _FAMILY_COLUMNS.items()) + f""" FROM lineitem), g AS ({_FAMILY_ROWS})
SELECT family, count(*) AS n_features, count(*) FILTER (WHERE feature IN ('VV__mean', 'T2M__mean')) AS n_selected, round(avg(pct), 7) AS mean_missing_pct FROM g GROUP BY family""")
def family_shares(t: Tables) -> DataFrame:
    rows = t("lineitem").select(*(F.expr(v).alias(k) for k, v in _FAMILY_COLUMNS.items()))
    return family_profile(rows, list(_FAMILY_COLUMNS), ["VV__mean", "T2M__mean"]).withColumn("mean_missing_pct", F.round("mean_missing_pct", 7))


@query("target_histogram", _M + """, s AS (SELECT min(target) AS lo, (max(target) - min(target)) / 30 AS w, count(target) AS n FROM model),
c AS (SELECT CAST(least(floor((target - lo) / w), 29) AS INT) AS bin, count(*) AS n FROM model, s GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * w, 4) AS low, round(lo + (i + 1) * w, 4) AS high, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (s.n * w), 12) AS density
FROM range(30) r(i) CROSS JOIN s LEFT JOIN c ON c.bin = i""")
def target_histogram(t: Tables) -> DataFrame:
    out = histogram(model_rows(t), "target", 30)
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4), "density": F.round("density", 12)})


def _rounded(df: DataFrame, names: list[str], places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


_FIVE_ROUNDED = "round(min({0}), 6) AS low, round(quantile_cont({0}, 0.25), 6) AS q1, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.75), 6) AS q3, round(max({0}), 6) AS high"


@query("target_boxes_by_season", _M + f"SELECT season, {_FIVE_ROUNDED.format('target')} FROM model GROUP BY season")
def target_boxes_by_season(t: Tables) -> DataFrame:
    return _rounded(box_stats(model_rows(t), "season", "target"), ["low", "q1", "median", "q3", "high"], 6)


@query("data_profile", _M + " UNION ALL ".join([
    *(f"SELECT 'missing' AS section, '{c}' AS item, '' AS part, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 6) AS value FROM model" for c in ["target", "season", "area", *_X]),
    *(f"SELECT 'missing_by_group', '{c}', season, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 6) FROM model GROUP BY season" for c in ["target", "area", *_X]),
    *(f"SELECT 'target_correlations', '{c}', '', round(abs(corr({c}, target)), 6) FROM model" for c in _X),
    "SELECT 'target_by_group', 'median', season, round(quantile_cont(target, 0.5), 4) FROM model GROUP BY season",
    "SELECT 'target', 'mean', '', round(avg(target), 4) FROM model", "SELECT 'target_histogram', 'n', '', CAST(count(target) AS DOUBLE) FROM model",
    "SELECT 'target_quantiles', 'n', '', CAST(count(target) AS DOUBLE) FROM model",
]))
def data_profile_rows(t: Tables) -> DataFrame:
    """The tables of a profile, one value a row; of the distributions the number of rows that they cover."""
    tables = data_profile(model_rows(t), "target", "season", ("row_id",))
    row = lambda df, name, item, part, value, places=6: df.select(
        F.lit(name).alias("section"), item.alias("item"), part.alias("part"), F.round(value.cast("double"), places).alias("value"))
    none, feature = F.lit(""), F.col("feature")
    parts = [
        row(tables["missing"], "missing", feature, none, F.col("pct")),
        row(tables["missing_by_group"], "missing_by_group", feature, F.col("season"), F.col("pct")),
        row(tables["target_correlations"], "target_correlations", feature, none, F.col("abs_r")),
        row(tables["target_by_group"], "target_by_group", F.lit("median"), F.col("season"), F.col("median"), 4),
        row(tables["target"], "target", F.lit("mean"), none, F.col("mean"), 4),
        row(tables["target_histogram"].agg(F.sum("n").alias("n")), "target_histogram", F.lit("n"), none, F.col("n")),
        row(tables["target_quantiles"].agg(F.count("*").alias("n")), "target_quantiles", F.lit("n"), none, F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("narrowed_quantiles", " UNION ALL ".join(
    f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem GROUP BY ALL" for p in (0.01, 0.25, 0.5, 0.99)))
def narrowed_quantiles(t: Tables) -> DataFrame:
    """Counting passes over leading bits, per group."""
    rows = t("lineitem").select("l_returnflag", "l_extendedprice")
    return _rounded(grouped_quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.01, 0.25, 0.5, 0.99]), ["value"], 6)


@query("column_quantiles", _M + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value FROM model" for c in _X for p in (0.1, 0.5, 0.9)))
def quantiles_of_columns(t: Tables) -> DataFrame:
    return _rounded(column_quantiles(model_rows(t), list(_X), [0.1, 0.5, 0.9]), ["value"], 6)


@query("average_ranks", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, count(*) AS cnt, CAST(sum(count(*)) OVER (ORDER BY {c}) AS DOUBLE) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS avg_rank"
    f" FROM lineitem GROUP BY {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def average_ranks(t: Tables) -> DataFrame:
    long = unpivot(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return average_rank(long, ["feature"], "x")


def _sql_poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}) * {x} + {c!r}::DOUBLE"
    return f"({out})"


def _sql_normal_quantile(p: str) -> str:
    a, b, c, d = NORMAL_COEFFICIENTS
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5::DOUBLE)"
    square = f"({mid} * {mid})"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {_sql_poly(low, c)} / {_sql_poly(low, d)} "
        f"WHEN {p} > 0.97575 THEN -{_sql_poly(high, c)} / {_sql_poly(high, d)} "
        f"ELSE {_sql_poly(square, a)} * {mid} / {_sql_poly(square, b)} END"
    )


@query("quantile_quantile_points", f"""
    WITH placed AS (
        SELECT CAST(o_totalprice AS DOUBLE) AS value, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n
        FROM orders WHERE o_totalprice IS NOT NULL),
    shares AS (
        SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n)
            ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM placed)
    SELECT i, value, round({_sql_normal_quantile("p")}, 9) AS normal FROM shares
""")
def quantile_quantile_points(t: Tables) -> DataFrame:
    return _rounded(qq_points(t("orders"), "o_totalprice"), ["normal"], 9)


_PREDICTED = "p AS (SELECT o_orderkey AS row_id, o_totalprice AS y, o_totalprice * 0.9::DOUBLE + o_custkey % 100 AS m1, o_totalprice + (o_orderkey % 11 - 5) * 1000 AS m2 FROM orders)"


def predicted(t: Tables) -> DataFrame:
    y = F.col("o_totalprice")
    return t("orders").select(
        F.col("o_orderkey").alias("row_id"), y.alias("y"), (y * 0.9 + F.col("o_custkey") % 100).alias("m1"), (y + (F.col("o_orderkey") % 11 - 5) * 1000).alias("m2")
    )


@query("model_residuals", ctes(_PREDICTED) + " UNION ALL ".join(
    f"SELECT row_id, '{m}' AS model, y AS actual, round({m}, 5) AS fitted, round({m} - y, 5) AS residual FROM p" for m in ("m1", "m2")))
def model_residuals(t: Tables) -> DataFrame:
    return _rounded(residuals(predicted(t), "y", ["m1", "m2"], ["row_id"]), ["fitted", "residual"], 5)


def _metrics_sql() -> str:
    parts = []
    for m in ("m1", "m2"):
        e = f"({m} - y)"
        for name, value in (("RMSE", f"sqrt(avg({e} * {e}))"), ("MAE", f"avg(abs({e}))"), ("R2", f"1 - sum({e} * {e}) / (var_pop(y) * count(y))"),
                            ("WAPE", f"sum(abs({e})) / (sum(abs(y)) + 1e-6) * 100")):
            parts.append(f"SELECT '{m}' AS model, '{name}' AS metric, round({value}, 6) AS value FROM p")
    return " UNION ALL ".join(parts)


@query("regression_metrics", ctes(_PREDICTED) + _metrics_sql())
def model_metrics(t: Tables) -> DataFrame:
    return _rounded(regression_metrics(predicted(t), "y", ["m1", "m2"]), ["value"], 6)


# ---- drift ----------------------------------------------------------------
# Reference: events before 16 January; scored: the rest.

_EDGES = """f AS (SELECT 'value' AS feature, value AS v, ts < TIMESTAMP '2024-01-16' AS ref FROM events UNION ALL SELECT 'user', CAST(user_id AS DOUBLE), ts < TIMESTAMP '2024-01-16' FROM events),
lim AS (SELECT feature, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM f WHERE ref GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]), lambda q: greatest(p1, least(p99, q))))) AS e
  FROM f JOIN lim USING (feature) WHERE ref GROUP BY feature, p1, p99),
bins AS (SELECT feature, CAST(i AS INT) AS bin, e[i] AS low, e[i + 1] AS high, i = len(e) - 1 AS last FROM edges, LATERAL (SELECT unnest(range(1, len(e))) AS i)),
hist AS (SELECT b.feature, b.bin, CAST(count(*) AS DOUBLE) AS n FROM bins b JOIN (SELECT feature, greatest(p1, least(p99, v)) AS v FROM f JOIN lim USING (feature) WHERE ref) c
  ON b.feature = c.feature AND v >= low AND (v < high OR (last AND v <= high)) GROUP BY ALL),
ref AS (SELECT b.*, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY b.feature) AS expected FROM bins b LEFT JOIN hist USING (feature, bin)),
act AS (SELECT b.feature, b.bin, CAST(count(*) AS DOUBLE) AS n FROM bins b JOIN f ON b.feature = f.feature AND NOT ref AND v >= low AND (v < high OR (last AND v <= high)) GROUP BY ALL),
psi AS (SELECT feature, sum((ex - ac) * ln(ex / ac)) AS psi FROM (SELECT r.feature, expected + 1e-6 AS ex, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.feature) + 1e-6 AS ac
  FROM ref r LEFT JOIN act USING (feature, bin)) GROUP BY feature)"""


def _drift_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t("events").select("ts", "value", F.col("user_id").cast("double").alias("user"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return rows.filter(early).select("value", "user"), rows.filter(~early).select("value", "user")


@query("drift_reference_bins", ctes(_EDGES) + "SELECT feature, bin, round(low, 6) AS low, round(high, 6) AS high, last, round(expected, 9) AS expected FROM ref")
def drift_reference_bins(t: Tables) -> DataFrame:
    out = psi_reference(_drift_sides(t)[0], ["value", "user"])
    return _rounded(_rounded(out, ["low", "high"], 6), ["expected"], 9)


@query("drift_scores", ctes(_EDGES) + "SELECT feature, round(psi, 8) AS psi FROM psi")
def drift_scores(t: Tables) -> DataFrame:
    early, late = _drift_sides(t)
    return _rounded(psi(psi_reference(early, ["value", "user"]), late), ["psi"], 8)


@query("data_quality_score", ctes(_EDGES) + """
SELECT round(greatest(0, 100 - (missing_pct * 0.5 + least(avg_psi, 1) * 50)), 6) AS data_quality_score, round(avg_psi, 8) AS avg_psi, round(missing_pct, 7) AS missing_pct
FROM (SELECT avg(psi) AS avg_psi FROM psi), (SELECT avg(CASE WHEN user_id % 9 = 0 THEN 50.0::DOUBLE ELSE 0 END) AS missing_pct FROM events WHERE ts >= TIMESTAMP '2024-01-16')""")
def data_quality(t: Tables) -> DataFrame:
    early, late = _drift_sides(t)
    scores = psi(psi_reference(early, ["value", "user"]), late)
    gappy = late.withColumn("value", F.when(F.col("user") % 9 != 0, F.col("value")))
    return _rounded(_rounded(_rounded(quality_score(gappy, ["value", "user"], scores), ["data_quality_score"], 6), ["avg_psi"], 8), ["missing_pct"], 7)


# ---- manifest and report --------------------------------------------------

@query("column_manifest", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS source, count({e}) AS n_filled, CAST(min({e}) AS VARCHAR) AS min, CAST(max({e}) AS VARCHAR) AS max FROM orders" for c, s, e in (
        ("date", "key", "CAST(o_orderdate AS DATE)"), ("price", "nasa_daily", "o_totalprice"), ("price_s2", "sentinel2_modis", "o_totalprice"),
        ("status", "sentinel2_modis", "CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END"), ("odd", "unknown", "o_custkey"))))
def manifest_of_columns(t: Tables) -> DataFrame:
    master = t("orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("price_s2"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("odd"),
    )
    stages = {"nasa_daily": (["price"], ""), "sentinel2_modis": (["price", "status"], "_s2")}
    return column_manifest(master, stages, ["date"])


@query("report_tables", ctes(_PREDICTED) + f""", m AS ({_metrics_sql()})
SELECT 'model' AS section, model || ' ' || metric AS item, value FROM m UNION ALL
SELECT 'best_model', (SELECT arg_min(model, value) FROM m WHERE metric = 'RMSE'), NULL UNION ALL SELECT 'data', 'rows', CAST(count(*) AS DOUBLE) FROM p UNION ALL
SELECT 'target', 'mean', round(avg(y), 6) FROM p UNION ALL SELECT 'target', 'std', round(stddev_samp(y), 6) FROM p UNION ALL SELECT 'target', 'skewness', round(skewness(y), 6) FROM p UNION ALL
SELECT 'target', 'min', min(y) FROM p UNION ALL SELECT 'target', 'max', max(y) FROM p UNION ALL
SELECT 'features', 'columns', 4 UNION ALL SELECT 'features', 'selected', 2 UNION ALL SELECT 'features', 'dropped', 1""")
def report_tables(t: Tables) -> DataFrame:
    rows = predicted(t)
    return _rounded(report_rows(regression_metrics(rows, "y", ["m1", "m2"]), rows, "y", 2, 1), ["value"], 6)


@query("drop_empty_deviation", "SELECT o_orderstatus, stddev_pop(0) AS kept__std, count(*) AS n FROM orders GROUP BY 1")
def drop_empty_deviation(t: Tables) -> DataFrame:
    rows = t("orders").groupBy("o_orderstatus").agg(
        F.stddev_pop(F.lit(0)).alias("kept__std"), F.stddev_pop(F.lit(None).cast("double")).alias("gone__std"), F.count("*").alias("n")
    )
    return drop_empty_std(rows)
