import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.operators import linear as L
from fieldlake.operators import models as M


def _frame(spark, x, y):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, float(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    return names, spark.createDataFrame(rows, "row_id bigint, y double, " + ", ".join(f"{n} double" for n in names)).repartition(5)


def _data(n=300, p=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) + 50
    return x, x @ np.array([3.0, -2.0, 0, 0, 1.0, 0][:p]) + 1000 + rng.normal(size=n)


def _plain_net(x, y, ratio, penalty, sweeps=20_000):
    """One coordinate at a time over the rows."""
    xc, yc, w = x - x.mean(axis=0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            pull = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(pull) * max(abs(pull) - penalty * ratio, 0) / (xc[:, j] @ xc[:, j] / len(y) + penalty * (1 - ratio))
        if np.abs(w - before).max() < 1e-12:
            break
    return w, y.mean() - x.mean(axis=0) @ w


@pytest.mark.parametrize("ratio, penalty", [(0.1, 0.01), (0.5, 0.3), (1.0, 0.5), (1.0, 1e4), (0.0, 2.0)])
def test_elastic_net_is_the_plain_one(spark, ratio, penalty):
    x, y = _data()
    names, frame = _frame(spark, x, y)
    model = M.fit_all(frame, [M.elastic_net_spec((ratio,), (penalty,))], names, "y", "row_id")["elastic_net"]
    w, start = _plain_net(x, y, ratio, penalty)
    assert model.coefficients == pytest.approx(w, abs=1e-5) and model.intercept == pytest.approx(start, abs=1e-3)
    got = {r.row_id: r.prediction for r in model.transform(M.assemble(frame, names)).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(x @ w + start, abs=1e-4)


def test_no_penalty_is_least_squares(spark):
    x, y = _data()
    names, frame = _frame(spark, x, y)
    model = M.fit_all(frame, [M.elastic_net_spec((0.5,), (0.0,))], names, "y", "row_id")["elastic_net"]
    want = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0]
    assert [*model.coefficients, model.intercept] == pytest.approx(want, rel=1e-7)


def test_path_chooses_as_fits_of_each_fold_do(spark):
    x, y = _data(90, 6)
    y = y + np.random.default_rng(1).normal(size=90) * 15
    names, frame = _frame(spark, x, y)
    fold = {r.row_id: r.f for r in frame.select("row_id", F.pmod(F.xxhash64("row_id", F.lit(29)), F.lit(3)).alias("f")).collect()}
    at, ratios, penalties = np.array([fold[i] for i in range(90)]), (0.1, 0.7, 1.0), (100.0, 10.0, 1.0, 0.1)
    errors = {}
    for ratio in ratios:
        for penalty in penalties:
            each = []
            for f in range(3):
                w, start = _plain_net(x[at != f], y[at != f], ratio, penalty)
                each.append(np.mean((y[at == f] - x[at == f] @ w - start) ** 2))
            errors[ratio, penalty] = np.mean(each)
    best = min(errors, key=errors.get)
    model = M.fit_all(frame, [M.elastic_net_spec(ratios, penalties, 3)], names, "y", "row_id")["elastic_net"]
    assert model.coefficients == pytest.approx(_plain_net(x, y, *best)[0], abs=1e-5)


def test_whole_path_in_one_aggregate(spark):
    x, y = _data(400, 6)
    wide = np.column_stack([x, np.random.default_rng(2).normal(size=(400, 34))])
    names, frame = _frame(spark, wide, y)
    began = time.time()
    model = M.fit_all(frame, [M.elastic_net_spec()], names, "y", "row_id")["elastic_net"]
    assert len(M.PENALTIES) == 50 and len(M.RATIOS) == 8 and time.time() - began < 60
    assert np.sqrt(np.mean((wide @ np.array(model.coefficients) + model.intercept - y) ** 2)) < 1.2


def test_elastic_net_of_odd_tables(spark):
    rows = [(i, None if i == 3 else float("nan") if i == 4 else 2.0 * i, float(i), 7.0, float(i)) for i in range(12)]
    frame = spark.createDataFrame(rows, "row_id bigint, y double, a double, flat double, copy double")
    ready = M.assemble(frame, ["a", "flat", "copy"], "y")
    for spec in (M.elastic_net_spec((0.5,), (0.0,)), M.elastic_net_spec((1.0,), (1e-6, 1e-3), 4)):
        model = spec.fit(ready, "row_id")
        assert model.coefficients[1] == 0 and model.coefficients[0] + model.coefficients[2] == pytest.approx(2.0, abs=1e-3)
    still = M.elastic_net_spec().fit(M.assemble(frame.withColumn("y", F.lit(5.0)), ["a", "flat"], "y"), "row_id")
    assert still.coefficients == [0.0, 0.0] and still.intercept == pytest.approx(5.0)
    alone = M.elastic_net_spec().fit(M.assemble(frame.limit(1), ["a"], "y"), "row_id")
    assert alone.coefficients == [0.0] and alone.intercept == 0.0
    for spec in (M.elastic_net_spec(), M.kernel_regression_spec(4)):
        with pytest.raises(ValueError, match="label"):
            spec.fit(ready.filter("y is null"), "row_id")


def test_cosine_line_bends_and_withstands_outliers(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, size=(900, 2))
    clean = 100 + 20 * np.sin(2 * x[:, 0]) + 5 * x[:, 1]
    y = clean + rng.normal(size=900)
    y[::15] += 400
    names, frame = _frame(spark, x, y)
    model = M.fit_all(frame, [M.kernel_regression_spec(96, (0.1, 0.5), (1e-5, 1e-3))], names, "y", "row_id")["kernel_regression"]
    got = {r.row_id: r.prediction for r in model.transform(M.assemble(frame, names)).collect()}
    error = np.sqrt(np.mean([(got[i] - clean[i]) ** 2 for i in range(900)]))
    assert error < 3 < np.std(clean) / 3


def test_huber_line_is_the_plain_one(spark):
    rng = np.random.default_rng(7)
    x, base, offsets = rng.normal(size=(250, 3)), rng.normal(size=(5, 3)), rng.uniform(0, 6, 5)
    y = 4 + x[:, 0] + rng.standard_t(2, 250)
    _, frame = _frame(spark, x, y)
    rows = frame.select(F.array("x0", "x1", "x2").alias("x"), "y", F.lit(False).alias("held"))
    (line, scale, _), = L.huber_lines(rows, base, offsets, [(0.3, 0.01)], y.mean(), y.std(), steps=200, tolerance=1e-10)
    z = np.column_stack([np.ones(250), np.cos(x @ (base * np.sqrt(0.6)).T + offsets)])
    r = (y - y.mean()) / y.std() - z @ line
    pull = z.T @ np.clip(r, -L.HUBER * scale, L.HUBER * scale) / 250 - 0.01 * np.append(0, line[1:])
    assert np.abs(pull).max() < 1e-8
    assert scale**2 == pytest.approx(np.mean(np.minimum(np.abs(r), L.HUBER * scale) ** 2) / L._HUBER_MEAN, rel=1e-6)


def test_many_cosines_plan_fast(spark):
    rng = np.random.default_rng(8)
    model = L.FourierModel(rng.normal(size=(512, 150)), rng.uniform(0, 6, 512), rng.normal(size=512), 1.0)
    data = spark.range(20).select("id", *(F.rand(j).alias(f"x{j}") for j in range(150)))
    ready = M.assemble(data, [f"x{j}" for j in range(150)])
    began = time.time()
    plan = model.transform(ready)
    plan._jdf.queryExecution().executedPlan()
    assert time.time() - began < 3 and plan.filter("prediction is null").count() == 0


def test_permutation_importance_is_that_of_shuffled_columns(spark):
    x, y = _data(500, 3)
    names, frame = _frame(spark, x, y)
    model = M.fit_all(frame, [M.elastic_net_spec((0.5,), (0.01,))], names, "y", "row_id")["elastic_net"]

    def rmse(rows):
        scored = model.transform(M.assemble(rows, names, "y"))
        return scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]

    base = rmse(frame)
    want = {n: rmse(M.permuted(frame, n, "row_id", groups=5)) - base for n in names}
    got = {r.feature: r.importance for r in M.permutation_importance(frame, model, names, "y", "row_id", 100).collect()}
    assert got == pytest.approx(want, rel=1e-9) and max(got, key=got.get) == "x0"


def test_permutation_importance_reads_rows_once_and_takes_empty_tables(spark):
    x, y = _data(60, 3)
    names, frame = _frame(spark, x, y)
    model = L.LineModel([1.0, 0.0, 2.0], 3.0)
    out = M.permutation_importance(frame, model, names, "y", "row_id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Window") == 2
    assert {r.feature: r.importance for r in out.collect()}["x1"] == pytest.approx(0.0, abs=1e-9)
    none = M.permutation_importance(frame.limit(0), model, names, "y", "row_id").collect()
    assert sorted((r.feature, r.importance) for r in none) == [("x0", None), ("x1", None), ("x2", None)]
