"""Screening, selection, folds, models, blending and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ModelConfig
from fieldlake.operators import models as M
from fieldlake.operators import screen as S
from fieldlake.operators.prep import Preprocessor, median_impute_apply, median_impute_fit
from fieldlake.operators.profile import corr_matrix
from fieldlake.operators.score import ScoringState, load_scoring_state, save_scoring_state, score
from fieldlake.operators.metrics import psi_reference
from fieldlake.queries.base import MODEL_SQL, Tables, ctes, model_rows, query
from fieldlake.queries.profiling import _PREDICTED, predicted
from fieldlake.session import shared_dir

_M = ctes(MODEL_SQL)
_X = ["x1", "x2", "x3", "x4"]


def _round(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


# ---- screening ------------------------------------------------------------

@query("low_variance_features", """
SELECT 'l_tax' AS feature, round(var_samp(l_tax), 9) AS variance FROM lineitem WHERE (SELECT var_samp(l_tax) FROM lineitem) < 0.001 UNION ALL
SELECT 'l_discount', round(var_samp(l_discount), 9) FROM lineitem WHERE (SELECT var_samp(l_discount) FROM lineitem) < 0.001""")
def low_variance_features(t: Tables) -> DataFrame:
    return _round(S.low_variance(t("lineitem"), ["l_tax", "l_discount", "l_quantity"], 0.001), ["variance"], 9)


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, target AS y FROM model WHERE {c} IS NOT NULL" for c in _X) + ")"
_RANKED = """ranked AS (SELECT *, count(*) OVER (PARTITION BY feature) AS n, rank() OVER (PARTITION BY feature ORDER BY x) - 1 AS bx, rank() OVER (PARTITION BY feature ORDER BY y) - 1 AS "by",
  rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM long)"""
_MI = """cells AS (SELECT feature, n, floor(16 * bx / n) AS i, floor(16 * "by" / n) AS j, CAST(count(*) AS DOUBLE) AS c FROM ranked GROUP BY ALL),
mi AS (SELECT feature, greatest(sum(c / n * ln(c * n / (px * py))), 0) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature, i) AS px, sum(c) OVER (PARTITION BY feature, j) AS py FROM cells) GROUP BY feature)"""


@query("target_association", ctes(MODEL_SQL, _LONG, _RANKED) + "SELECT feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM ranked GROUP BY feature")
def target_association(t: Tables) -> DataFrame:
    return _round(S.association(model_rows(t), _X, "target").select("feature", "n", "pearson", "spearman"), ["pearson", "spearman"])


@query("association_p_values")
def association_p_values(t: Tables) -> DataFrame:
    return S.association(model_rows(t), _X, "target")


@query("mutual_information", ctes(MODEL_SQL, _LONG, _RANKED, _MI) + "SELECT feature, round(mi, 6) AS mi FROM mi")
def mutual_information(t: Tables) -> DataFrame:
    return _round(S.binned_mi(model_rows(t), _X, "target"), ["mi"])


_SCORES = "s AS (SELECT feature, abs(corr(x, y)) AS p, abs(corr(rx, ry)) AS s, mi FROM ranked JOIN mi USING (feature) GROUP BY feature, mi)"
_RELEVANCE = "SELECT feature, round(" + " + ".join(
    f"{w} * coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)" for w, c in (("0.5::DOUBLE", "p"), ("0.25::DOUBLE", "s"), ("0.25::DOUBLE", "mi"))) + ", 6) AS relevance FROM s"


@query("feature_relevance", ctes(MODEL_SQL, _LONG, _RANKED, _MI, _SCORES) + _RELEVANCE)
def feature_relevance(t: Tables) -> DataFrame:
    rows = model_rows(t)
    pairs = S.ranked_pairs(rows, _X, "target")
    scores = S.association(rows, _X, "target", pairs).join(S.binned_mi(rows, _X, "target", pairs=pairs), "feature")
    return _round(S.relevance(scores).select("feature", "relevance"), ["relevance"])


# 1.2817 is the two-sided 20 % point of Student's t at these row counts; no feature's statistic lies near it
@query("significant_features", ctes(MODEL_SQL, _LONG, _RANKED) + """, c AS (SELECT feature, count(*) AS n, corr(x, y) AS p, corr(rx, ry) AS s FROM ranked GROUP BY feature)
SELECT feature, round(p, 6) AS pearson, round(s, 6) AS spearman FROM c WHERE abs(p) * sqrt((n - 2) / (1 - p * p)) > 1.2817::DOUBLE OR abs(s) * sqrt((n - 2) / (1 - s * s)) > 1.2817::DOUBLE""")
def significant_features(t: Tables) -> DataFrame:
    kept = S.significance_filter(S.association(model_rows(t), _X, "target"))
    return _round(kept.select("feature", "pearson", "spearman"), ["pearson", "spearman"])


_COPIES = """copies AS (SELECT l_quantity AS target, l_extendedprice AS a, l_extendedprice * 2 + l_linenumber * 1500 AS b, l_discount AS c, -l_discount + l_linenumber / 100000.0::DOUBLE AS d, l_tax AS e FROM lineitem)"""


def _copies(t: Tables) -> DataFrame:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return t("lineitem").select(
        F.col("l_quantity").alias("target"), price.alias("a"), (price * 2 + F.col("l_linenumber") * 1500).alias("b"), discount.alias("c"),
        (-discount + F.col("l_linenumber") / 100000.0).alias("d"), F.col("l_tax").alias("e"),
    )


def _mi_of(column: str) -> str:
    ranked = f"SELECT rank() OVER (ORDER BY {column}) - 1 AS bx, rank() OVER (ORDER BY target) - 1 AS \"by\", count(*) OVER () AS n FROM copies"
    cells = f"SELECT n, floor(16 * bx / n) AS i, floor(16 * \"by\" / n) AS j, CAST(count(*) AS DOUBLE) AS c FROM ({ranked}) GROUP BY ALL"
    return f"(SELECT sum(c / n * ln(c * n / (px * py))) FROM (SELECT *, sum(c) OVER (PARTITION BY i) AS px, sum(c) OVER (PARTITION BY j) AS py FROM ({cells})))"


@query("collinear_features", ctes(_COPIES) + f"""
SELECT CASE WHEN {_mi_of('a')} >= {_mi_of('b')} THEN 'b' ELSE 'a' END AS feature, CASE WHEN {_mi_of('a')} >= {_mi_of('b')} THEN 'a' ELSE 'b' END AS kept, round(abs(corr(a, b)), 6) AS r FROM copies UNION ALL
SELECT CASE WHEN {_mi_of('c')} >= {_mi_of('d')} THEN 'd' ELSE 'c' END, CASE WHEN {_mi_of('c')} >= {_mi_of('d')} THEN 'c' ELSE 'd' END, round(abs(corr(c, d)), 6) FROM copies""")
def collinear_features(t: Tables) -> DataFrame:
    return _round(S.corr_prune(_copies(t), ["a", "b", "c", "d", "e"], "target"), ["r"])


@query("family_backfill", ctes(_COPIES) + """SELECT 'one' AS family, CASE WHEN abs(corr(a, target)) >= abs(corr(e, target)) THEN 'a' ELSE 'e' END AS feature, round(greatest(abs(corr(a, target)), abs(corr(e, target))), 6) AS abs_r FROM copies""")
def family_backfill_rows(t: Tables) -> DataFrame:
    out = S.family_backfill(_copies(t), "target", {"one": ["a", "e"], "two": ["c", "d"]}, ["c", "target"])
    return _round(out, ["abs_r"])


@query("selected_features")
def selected_features(t: Tables) -> DataFrame:
    rows = _copies(t)
    names = ["a", "b", "c", "d", "e"]
    scores = S.feature_scores(rows, names, "target", alpha=1.1)
    chosen = S.mrmr_select(scores, corr_matrix(rows, names), {"one": ["a", "b"], "two": ["c", "d"]}, 4)
    return rows.select(*chosen).agg(*(F.avg(c).alias(c) for c in chosen))


_INTER = "i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS target, l_quantity AS a, l_quantity + l_linenumber AS b, l_quantity - l_discount * 100 AS c, l_quantity * 2 + l_tax * 300 AS d, l_quantity + l_suppkey AS e FROM lineitem)"


@query("interaction_features", ctes(_INTER) + """, r AS (SELECT name, row_number() OVER (ORDER BY r DESC, name) AS k FROM (SELECT 'a' AS name, abs(corr(a, target)) AS r FROM i UNION ALL SELECT 'b', abs(corr(b, target)) FROM i
  UNION ALL SELECT 'c', abs(corr(c, target)) FROM i UNION ALL SELECT 'd', abs(corr(d, target)) FROM i UNION ALL SELECT 'e', abs(corr(e, target)) FROM i)),
v AS (SELECT i.*, k, CASE name WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c WHEN 'd' THEN d ELSE e END AS v FROM i CROSS JOIN r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(max(v) FILTER (WHERE k = 1) * max(v) FILTER (WHERE k = 2), 5) + 0.0::DOUBLE AS first_second,
  round(max(v) FILTER (WHERE k = 3) * max(v) FILTER (WHERE k = 4), 5) + 0.0::DOUBLE AS third_fourth FROM v GROUP BY 1, 2, 3, 4, target""")
def interaction_features(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("target"), q.alias("a"), (q + F.col("l_linenumber")).alias("b"),
        (q - F.col("l_discount") * 100).alias("c"), (q * 2 + F.col("l_tax") * 300).alias("d"), (q + F.col("l_suppkey")).alias("e"),
    )
    names = S.interaction_columns(rows, "target", ["a", "b", "c", "d", "e"])
    out = S.interactions(rows, names)
    first, last = f"interaction_{names[0]}_{names[1]}", f"interaction_{names[2]}_{names[3]}"
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(first, 5) + F.lit(0.0)).alias("first_second"), (F.round(last, 5) + F.lit(0.0)).alias("third_fourth"))


# ---- folds ----------------------------------------------------------------

@query("row_folds", _M + "SELECT row_id, CAST(row_id % 5 AS INT) AS fold FROM model")
def row_folds(t: Tables) -> DataFrame:
    return M.kfold(model_rows(t).select("row_id"), "row_id", 5, seed=None)


@query("seeded_folds")
def seeded_folds(t: Tables) -> DataFrame:
    return M.kfold(model_rows(t).select("row_id"), "row_id", 5)


@query("group_folds", """
WITH RECURSIVE sizes AS (SELECT c_nationkey || '_' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS k FROM sizes),
walk(k, fold, a, b, c) AS (SELECT 0::BIGINT, -1, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT k, fold, a + CASE WHEN fold = 0 THEN n ELSE 0 END, b + CASE WHEN fold = 1 THEN n ELSE 0 END, c + CASE WHEN fold = 2 THEN n ELSE 0 END FROM (
    SELECT o.k, n, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold FROM walk w JOIN o ON o.k = w.k + 1))
SELECT c_custkey, CAST(fold AS INT) AS fold FROM customer JOIN o ON o.g = c_nationkey || '_' || c_mktsegment JOIN walk USING (k)""")
def group_folds(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return M.group_kfold(rows, ["c_nationkey", "c_mktsegment"], 3).select("c_custkey", "fold")


# ---- models ---------------------------------------------------------------

def _filled(t: Tables) -> DataFrame:
    rows = model_rows(t).select("row_id", "target", *_X)
    return median_impute_apply(rows, median_impute_fit(rows, _X))


def specs() -> list[M.ModelSpec]:
    """Settings small enough for a check; the library defaults are larger."""
    return [
        M.gbt_spec(max_iter=10, step=0.3, depth=4), M.rf_spec(trees=20, depth=6), M.kernel_regression_spec(components=16, gammas=(0.05,), penalties=(0.01,)),
        M.elastic_net_spec(ratios=(0.5,), penalties=(0.01, 1.0), inner=2),
    ]


@query("out_of_fold_predictions")
def out_of_fold_predictions(t: Tables) -> DataFrame:
    return M.oof_predict(M.kfold(_filled(t), "row_id", 3), specs(), _X, "target", "row_id", 3)


@query("final_model_predictions")
def final_model_predictions(t: Tables) -> DataFrame:
    rows, tried = _filled(t), [M.rf_spec(trees=10, depth=5), M.elastic_net_spec(ratios=(0.5,), penalties=(0.01,), inner=2)]
    oof = M.oof_predict(M.kfold(rows, "row_id", 2), tried, _X, "target", "row_id", 2)
    _, model = M.fit_final(rows, tried, oof, _X, "target", "row_id")
    return model.transform(M.assemble(rows, _X)).select("row_id", "prediction")


@query("tree_feature_importance")
def tree_feature_importance(t: Tables) -> DataFrame:
    model = M.fit_all(_filled(t), [M.rf_spec(trees=20, depth=6)], _X, "target", "row_id")["random_forest"]
    return M.tree_importance(model, _X, t.spark)


@query("permutation_importance")
def permutation_importances(t: Tables) -> DataFrame:
    rows = _filled(t)
    model = M.fit_all(rows, [M.elastic_net_spec(ratios=(0.5,), penalties=(0.01,), inner=2)], _X, "target", "row_id")["elastic_net"]
    return M.permutation_importance(rows, model, _X, "target", "row_id")


@query("linear_attribution", _M + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m))), 6) AS shapley FROM model, (SELECT avg({c}) AS m FROM model)" for c, w in (("x1", "2.5::DOUBLE"), ("x2", "-1.25::DOUBLE"), ("x3", "0.5::DOUBLE"))))
def linear_attribution(t: Tables) -> DataFrame:
    return _round(M.linear_shapley(model_rows(t), {"x1": 2.5, "x2": -1.25, "x3": 0.5}), ["shapley"])


# ---- least squares ---------------------------------------------------------
# Without a penalty the elastic net is least squares, which SQL has in closed form for two features.

_MOMENTS = ", ".join(f"covar_pop({a}, {b}) AS {n}" for a, b, n in (("x1", "x1", "s11"), ("x1", "x2", "s12"), ("x2", "x2", "s22"), ("x1", "target", "s1"), ("x2", "target", "s2")))
_MOMENTS += ", avg(x1) AS a1, avg(x2) AS a2, avg(target) AS ay"
_LINE = "ay + (x1 - a1) * (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) + (x2 - a2) * (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12)"


def _both(t: Tables) -> DataFrame:
    return model_rows(t).select("row_id", "target", "x1", "x2").dropna()


def _plain() -> M.ModelSpec:
    return M.elastic_net_spec(ratios=(0.5,), penalties=(0.0,))


@query("least_squares_predictions", ctes(MODEL_SQL) + f"""SELECT row_id, round({_LINE}, 2) AS prediction
FROM model, (SELECT {_MOMENTS} FROM model WHERE x1 IS NOT NULL AND x2 IS NOT NULL) WHERE x1 IS NOT NULL AND x2 IS NOT NULL""")
def least_squares_predictions(t: Tables) -> DataFrame:
    rows = _both(t)
    model = M.fit_all(rows, [_plain()], ["x1", "x2"], "target", "row_id")["elastic_net"]
    return model.transform(M.assemble(rows, ["x1", "x2"])).select("row_id", F.round("prediction", 2).alias("prediction"))


@query("out_of_fold_least_squares", ctes(MODEL_SQL) + f""", b AS (SELECT *, row_id % 3 AS fold FROM model WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
fits AS (SELECT f.fold, {_MOMENTS} FROM b JOIN (SELECT DISTINCT fold FROM b) f ON b.fold <> f.fold GROUP BY f.fold)
SELECT row_id, target, CAST(fold AS INT) AS fold, round({_LINE}, 2) AS elastic_net FROM b JOIN fits USING (fold)""")
def out_of_fold_least_squares(t: Tables) -> DataFrame:
    folded = M.kfold(_both(t), "row_id", 3, seed=None)
    return _round(M.oof_predict(folded, [_plain()], ["x1", "x2"], "target", "row_id", 3), ["elastic_net"], 2)


_WEIGHTS = "(s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2, a1, a2"


@query("least_squares_attribution", ctes(MODEL_SQL) + f""", b AS (SELECT * FROM model WHERE x1 IS NOT NULL AND x2 IS NOT NULL), w AS (SELECT {_WEIGHTS} FROM (SELECT {_MOMENTS} FROM b))
SELECT 'elastic_net' AS model, 'x1' AS feature, true AS helps, round(avg(abs(b1 * (x1 - a1))), 2) AS shapley FROM b, w UNION ALL
SELECT 'elastic_net', 'x2', NULL, round(avg(abs(b2 * (x2 - a2))), 2) FROM b, w""")
def least_squares_attribution(t: Tables) -> DataFrame:
    """x1 carries the target: shuffling it costs accuracy. Whether x2 does is chance and not compared."""
    rows = _both(t)
    models = M.fit_all(rows, [_plain()], ["x1", "x2"], "target", "row_id")
    out = M.attribution(models, rows, ["x1", "x2"], "target", "row_id")
    return out.select("model", "feature", F.when(F.col("feature") == "x1", F.col("importance") > 0).alias("helps"), F.round("shapley", 2).alias("shapley"))


# ---- blending -------------------------------------------------------------

_GRID = M.simplex(2, 10, [0.0, 0.05])


@query("blend_candidate_errors", ctes(_PREDICTED) + "SELECT id, round(avg(abs(y - (w1 * m1 + w2 * m2))), 5) AS mae FROM p CROSS JOIN (VALUES " + ", ".join(
    f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(_GRID)) + ") c(id, w1, w2) GROUP BY id")
def blend_candidate_errors(t: Tables) -> DataFrame:
    return _round(M.blend_errors(predicted(t), "y", ["m1", "m2"], _GRID), ["mae"], 5)


@query("blend_weights", ctes(_PREDICTED) + """, e AS (SELECT w1, w2, avg(abs(y - (w1 * m1 + w2 * m2))) AS mae FROM p CROSS JOIN (VALUES """ + ", ".join(
    f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(_GRID)) + ") c(id, w1, w2) GROUP BY ALL) SELECT round(arg_min(w1, mae), 9) AS m1, round(arg_min(w2, mae), 9) AS m2 FROM e")
def blend_weight_row(t: Tables) -> DataFrame:
    rows = predicted(t)
    weights = M.blend_weights(rows, "y", ["m1", "m2"], {"m2": 0.05}, refinements=0)
    return rows.agg(*(F.round(F.max(F.lit(w)), 9).alias(m) for m, w in weights.items()))


# With two models the error is a sum of |a + w b|, least at the weighted median of -a / b.
@query("blend_optimum", ctes(_PREDICTED) + """, s AS (SELECT m1 - y AS a, m2 - m1 AS b FROM p),
  t AS (SELECT -a / b AS spot, sum(abs(b)) OVER (ORDER BY -a / b) AS run, sum(abs(b)) OVER () AS total FROM s WHERE b <> 0),
  w AS (SELECT greatest(0.05::DOUBLE, least(1.0::DOUBLE, min(spot))) AS w2 FROM t WHERE run >= total / 2)
SELECT count(*) AS n, round(avg(abs((1 - w2) * m1 + w2 * m2 - y)), 1) AS mae FROM p, w""")
def blend_optimum(t: Tables) -> DataFrame:
    rows = predicted(t)
    weights = M.convex_blend(rows, "y", ["m1", "m2"], {"m2": 0.05})
    return M.blended(rows, weights).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("ensemble") - F.col("y"))), 1).alias("mae"))


@query("champion_model", ctes(_PREDICTED) + """, q AS (SELECT *, 0.25 * m1 + 0.75 * m2 AS ensemble FROM p), r AS (SELECT 'm1' AS model, round(sqrt(avg(pow(m1 - y, 2))), 6) AS rmse FROM q
  UNION ALL SELECT 'm2', round(sqrt(avg(pow(m2 - y, 2))), 6) FROM q UNION ALL SELECT 'ensemble', round(sqrt(avg(pow(ensemble - y, 2))), 6) FROM q)
SELECT model, rmse, rmse = min(rmse) OVER () AS is_best FROM r""")
def champion_model(t: Tables) -> DataFrame:
    table = M.champion(predicted(t), "y", {"m1": 0.25, "m2": 0.75})
    return table.filter("metric = 'RMSE'").select("model", F.round("value", 6).alias("rmse"), "is_best")


# ---- scoring --------------------------------------------------------------

@query("scored_rows")
def scored_rows(t: Tables) -> DataFrame:
    """Fit on one part of the rows, score all of them through the stored state."""
    names = {"x1": "T2M__mean", "x2": "RH2M__mean", "x3": "sand_0-5cm_mean", "x4": "VV__mean", "area": "fp_Area"}
    cfg = ModelConfig(target="target", category_columns=("fp_Area",))
    rows = model_rows(t).drop("season").withColumnsRenamed(names)
    train = rows.filter("fp_Area < '4'")
    steps = Preprocessor(cfg)
    ready = steps.fit_transform(train)
    features = ["T2M__mean", "RH2M__mean", "VV__mean", "fp_Area_2-HIGH"]
    fitted = M.fit_all(ready, [M.elastic_net_spec(ratios=(0.5,), penalties=(0.01,), inner=2)], features, "target", "row_id")
    state = ScoringState(steps, features, fitted, {"elastic_net": 1.0}, [], psi_reference(train, ["T2M__mean"]))
    path = f"{shared_dir(t.spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    save_scoring_state(state, t.spark, path)
    return score(rows.drop("target"), load_scoring_state(t.spark, path))[0]
