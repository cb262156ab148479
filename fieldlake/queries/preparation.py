"""Fit/apply preparation steps over the model rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ModelConfig
from fieldlake.operators import prep as P
from fieldlake.queries.base import MODEL_SQL, Tables, ctes, model_rows, query

_M = ctes(MODEL_SQL)
_X = ["x1", "x2", "x3", "x4"]
# Rows the steps are fitted on: orders of the two highest priorities; all rows are then transformed.
_TRAIN = "train AS (SELECT * FROM model WHERE row_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3'))"
_MT = ctes(MODEL_SQL, _TRAIN)


def _train(t: Tables) -> DataFrame:
    return model_rows(t).filter("area < '3'")


def _round(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


@query("winsor_limits", _MT + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 6) AS low, round(quantile_cont({c}, 0.99), 6) AS high FROM train" for c in _X))
def winsor_limits(t: Tables) -> DataFrame:
    return _round(P.winsor_fit(_train(t), _X), ["low", "high"])


@query("winsorised_rows", _MT + ", l AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _X) + " FROM train) SELECT row_id, "
       + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest({c}_lo, least({c}_hi, {c})) END, 6) AS {c}" for c in _X) + " FROM model, l")
def winsorised_rows(t: Tables) -> DataFrame:
    rows = P.winsor_apply(model_rows(t), P.winsor_fit(_train(t), _X))
    return _round(rows.select("row_id", *_X), _X)


@query("median_imputed_rows", _MT + ", m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in _X) + " FROM train) SELECT row_id, "
       + ", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in _X) + " FROM model, m")
def median_imputed_rows(t: Tables) -> DataFrame:
    rows = P.median_impute_apply(model_rows(t), P.median_impute_fit(_train(t), _X))
    return _round(rows.select("row_id", *_X), _X)


@query("fallback_medians", _M + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM model" for c in ("x1", "x2", "x4")))
def fallback_medians(t: Tables) -> DataFrame:
    return _round(P.fallback_impute_fit(model_rows(t), _X), ["median"])


_CODES = """l AS (SELECT 'area' AS f, area AS v, CAST(row_number() OVER (ORDER BY area) - 1 AS INT) AS code FROM (SELECT DISTINCT area FROM train)
  UNION ALL SELECT 'season', s, CAST(row_number() OVER (ORDER BY s) - 1 AS INT) FROM (SELECT DISTINCT coalesce(season, '__nan__') AS s FROM train)),
u AS (SELECT area AS v, CAST(row_number() OVER (ORDER BY area) - 1 + (SELECT count(*) FROM l WHERE f = 'area') AS INT) AS code FROM (SELECT DISTINCT area FROM model WHERE area NOT IN (SELECT area FROM train)))"""


@query("label_codes", _MT + f", {_CODES} " + """
SELECT row_id, coalesce(a.code, u.code) AS area__code, s.code AS season__code FROM model LEFT JOIN l a ON a.f = 'area' AND a.v = area LEFT JOIN u ON u.v = area
LEFT JOIN l s ON s.f = 'season' AND s.v = coalesce(season, '__nan__')""")
def label_codes(t: Tables) -> DataFrame:
    """Fitted on part of the areas, so that the others get codes after the known ones."""
    columns = ["area", "season"]
    return P.label_encode_apply(model_rows(t), P.label_encode_fit(_train(t), columns), columns).select("row_id", "area__code", "season__code")


_MANY = """o AS (SELECT o_orderkey AS row_id, o_custkey || '/' || o_orderkey % 97 AS v FROM orders),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT v FROM o WHERE row_id % 3 <> 0)),
u AS (SELECT v, row_number() OVER (ORDER BY v) - 1 + (SELECT count(*) FROM k) AS code FROM (SELECT DISTINCT v FROM o ANTI JOIN k USING (v)))"""


@query("label_codes_many_levels", ctes(_MANY) + "SELECT row_id, CAST(coalesce(k.code, u.code) AS INT) AS v__code FROM o LEFT JOIN k USING (v) LEFT JOIN u USING (v)")
def label_codes_many_levels(t: Tables) -> DataFrame:
    """Nearly as many levels as rows, a third of the rows not in the fit."""
    level = F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 97).cast("string"))
    rows = t("orders").select(F.col("o_orderkey").alias("row_id"), level.alias("v"))
    return P.label_encode_apply(rows, P.label_encode_fit(rows.filter("row_id % 3 <> 0"), ["v"]), ["v"]).select("row_id", "v__code")


@query("one_hot_rows", _MT + """SELECT row_id, coalesce(area = '2-HIGH', false)::INT AS "area_2-HIGH", coalesce(season = 'O', false)::INT AS "season_O", coalesce(season = 'P', false)::INT AS "season_P" FROM model""")
def one_hot_rows(t: Tables) -> DataFrame:
    rows = P.one_hot_apply(model_rows(t), P.one_hot_fit(_train(t), ["area", "season"]))
    return rows.drop("target", *_X)


@query("robust_scaled_rows", _MT + ", m AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s" for c in [*_X, "flat"]) + " FROM (SELECT *, 1.5::DOUBLE AS flat FROM train)) SELECT row_id, "
       + ", ".join(f"round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}" for c in [*_X, "flat"]) + ", 0.0::DOUBLE AS absent FROM (SELECT *, 1.5::DOUBLE + row_id % 2 AS flat FROM model), m")
def robust_scaled_rows(t: Tables) -> DataFrame:
    """A constant column divides by 1; a column absent at scoring is filled with its median."""
    train = _train(t).withColumns({"flat": F.lit(1.5), "absent": F.col("target")})
    state = P.robust_scale_fit(train, [*_X, "flat", "absent"])
    rows = P.robust_scale_apply(model_rows(t).withColumn("flat", F.lit(1.5) + F.col("row_id") % 2), state)
    return _round(rows.select("row_id", *_X, "flat", "absent"), [*_X, "flat"])


@query("neighbour_imputed_rows", ctes(MODEL_SQL, "s AS (SELECT row_id, season, area, x2, x3, x4 FROM model)",
"g AS (SELECT * FROM s WHERE x2 IS NULL OR x4 IS NULL)",
"""c AS (SELECT g.row_id, b.row_id AS donor, g.x2 IS NULL AS gap2, g.x4 IS NULL AS gap4, b.x2, b.x4,
  (CASE WHEN g.x2 IS NOT NULL AND b.x2 IS NOT NULL THEN pow(g.x2 - b.x2, 2) ELSE 0 END + CASE WHEN g.x4 IS NOT NULL AND b.x4 IS NOT NULL THEN pow(g.x4 - b.x4, 2) ELSE 0 END + pow(g.x3 - b.x3, 2))
  * 3 / ((g.x2 IS NOT NULL AND b.x2 IS NOT NULL)::INT + (g.x4 IS NOT NULL AND b.x4 IS NOT NULL)::INT + 1) AS d FROM g JOIN s b ON g.season = b.season AND g.area = b.area)""",
"f2 AS (SELECT row_id, avg(x2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, donor) AS r FROM c WHERE gap2 AND x2 IS NOT NULL) WHERE r <= 5 GROUP BY 1)",
"f4 AS (SELECT row_id, avg(x4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, donor) AS r FROM c WHERE gap4 AND x4 IS NOT NULL) WHERE r <= 5 GROUP BY 1)")
 + "SELECT row_id, round(coalesce(x2, f2.v), 6) AS x2, x3, round(coalesce(x4, f4.v), 6) AS x4 FROM s LEFT JOIN f2 USING (row_id) LEFT JOIN f4 USING (row_id)")
def neighbour_imputed_rows(t: Tables) -> DataFrame:
    rows = model_rows(t).select("row_id", "season", "area", "x2", "x3", "x4")
    out = P.knn_impute(rows, ["x2", "x4"], ["x3"], "row_id", ["season", "area"])
    return _round(out.select("row_id", "x2", "x3", "x4"), ["x2", "x4"])


@query("neighbour_imputed_unblocked", ctes(MODEL_SQL,
"""g AS (SELECT DISTINCT x1, x3 FROM (SELECT round(x1, 0) AS x1, x3, x4 FROM model) WHERE x4 IS NULL)""",
"""c AS (SELECT g.x1, g.x3, b.x4, (coalesce(pow(g.x1 - b.x1, 2), 0) + pow(g.x3 - b.x3, 2)) * 3 / ((g.x1 IS NOT NULL AND b.x1 IS NOT NULL)::INT + 1) AS d, b.row_id AS donor
  FROM g JOIN (SELECT row_id, round(x1, 0) AS x1, x3, x4 FROM model WHERE x4 IS NOT NULL) b ON true)""",
"f AS (SELECT x1, x3, avg(x4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY x1, x3 ORDER BY d, donor) AS r FROM c) WHERE r <= 5 GROUP BY 1, 2)")
 + """SELECT m.row_id, round(m.x1, 0) AS x1, m.x3, round(coalesce(m.x4, f.v), 6) AS x4 FROM model m
LEFT JOIN f ON f.x1 IS NOT DISTINCT FROM round(m.x1, 0) AND f.x3 = m.x3""")
def neighbour_imputed_unblocked(t: Tables) -> DataFrame:
    """One block: every gap is searched among all rows."""
    rows = model_rows(t).select("row_id", F.round("x1", 0).alias("x1"), "x3", "x4")
    return _round(P.knn_impute(rows, ["x4"], ["x1", "x3"], "row_id"), ["x4"])


@query("iterative_imputed_rows")
def iterative_imputed_rows(t: Tables) -> DataFrame:
    rows = model_rows(t).select("row_id", *_X)
    return P.iterative_impute_apply(rows, P.iterative_impute_fit(rows, _X), _X)


@query("iterative_imputed_pair", _M + """, k AS (SELECT regr_slope(x1, target) AS b, regr_intercept(x1, target) AS a FROM model)
SELECT row_id, target, round(coalesce(x1, a + b * target), 0) AS x1 FROM model, k""")
def iterative_imputed_pair(t: Tables) -> DataFrame:
    """With two columns the fit is one regression; the ridge's shrinkage lies far below the rounding."""
    rows = model_rows(t).select("row_id", "target", "x1")
    out = P.iterative_impute_apply(rows, P.iterative_impute_fit(rows, ["target", "x1"]), ["target", "x1"])
    return _round(out, ["x1"], 0)


@query("rows_without_nulls", _M + "SELECT row_id, x3 FROM model")
def rows_without_nulls(t: Tables) -> DataFrame:
    return P.assert_no_nulls(model_rows(t).select("row_id", "x3"), ["row_id", "x3"])


@query("prepared_rows")
def prepared_rows(t: Tables) -> DataFrame:
    """The whole preprocessor, fitted on part of the rows and applied to all."""
    names = {"x1": "T2M__mean", "x2": "NDVI__mean", "x3": "sand_0-5cm_mean", "x4": "RH2M__mean", "area": "fp_Area", "season": "fp_Season"}
    cfg = ModelConfig(target="target", category_columns=("fp_Area", "fp_Season"))
    steps = P.Preprocessor(cfg).fit(_train(t).withColumnsRenamed(names))
    return steps.transform(model_rows(t).withColumnsRenamed(names))
