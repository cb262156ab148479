import threading

import numpy as np
import pytest
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from fieldlake.config import ModelConfig
from fieldlake.operators import models as M
from fieldlake.operators import neighbours as N
from fieldlake.operators import order
from fieldlake.operators import prep as P
from fieldlake.session import at_once


def test_folds_are_worked_on_side_by_side(spark):
    frame = spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    met = threading.Barrier(2, timeout=120)  # breaks where one fold ends before the other begins

    def build(train, row_id):
        met.wait()
        return SQLTransformer(statement="SELECT *, label AS prediction FROM __THIS__")

    out = M.oof_predict(M.kfold(frame, "row_id", 2), [M.ModelSpec("same", build)], ["x"], "y", "row_id", 2).collect()
    assert sorted((r["row_id"], r["same"]) for r in out) == [(i, 2.0 * i) for i in range(60)]


def test_works_keep_their_order_and_errors_are_raised(spark):
    assert at_once(spark, [lambda i=i: spark.range(i).count() for i in (5, 0, 3, 1)]) == [5, 0, 3, 1]
    assert at_once(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        at_once(spark, [lambda: 1, lambda: 1 // 0])


def scans(monkeypatch):
    seen, real = [], order._pass
    monkeypatch.setattr(order, "_pass", lambda *a: seen.append(a[-1]) or real(*a))
    return seen


def test_few_rows_are_settled_by_few_scans(spark, monkeypatch):
    seen = scans(monkeypatch)
    data = np.random.default_rng(3).normal(size=4000)
    frame = spark.createDataFrame([(float(v), None) for v in data], "a double, b double")
    got = {(r["feature"], r["p"]): r["value"] for r in order.column_quantiles(frame, ["a", "b"], [0.0, 0.3, 0.5, 1.0]).collect()}
    assert seen == [order.SHIFTS[0], 0]
    assert got == {("a", p): pytest.approx(float(np.quantile(data, p)), rel=1e-12) for p in (0.0, 0.3, 0.5, 1.0)}


@pytest.mark.parametrize("few", [0, 500, 1 << 18])
def test_scans_of_any_length_give_the_same_values(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW_ROWS", few)
    rng = np.random.default_rng(4)
    data = {"hot": np.where(rng.random(3000) < 0.5, -7.0, rng.normal(size=3000)), "wide": 10.0 ** rng.uniform(-300, 298, 3000) * rng.choice([-1, 1], 3000)}
    frame = spark.createDataFrame([tuple(map(float, v)) for v in zip(*data.values())], "hot double, wide double")
    for r in order.column_quantiles(frame, list(data), [0.01, 0.25, 0.5, 0.99]).collect():
        assert r["value"] == pytest.approx(float(np.quantile(data[r["feature"]], r["p"])), rel=1e-9)


def test_donors_are_cut_into_chunks_once(spark, monkeypatch):
    made, real = [], N.donor_chunks
    monkeypatch.setattr(N, "donor_chunks", lambda *a: made.append(1) or real(*a))
    monkeypatch.setattr(P, "donor_chunks", N.donor_chunks, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), None if i % 7 == 0 else float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(200)]
    frame = spark.createDataFrame(rows, "row_id bigint, yield double, NDVI__mean double, EVI__mean double, fp_Area string")
    steps = P.Preprocessor(ModelConfig(target="yield", category_columns=("fp_Area",)))
    fitted = {r["row_id"]: r["NDVI__mean"] for r in steps.fit_transform(frame).collect()}
    assert len(made) == 1
    again = {r["row_id"]: r["NDVI__mean"] for r in steps.transform(frame).collect()}
    assert len(made) == 1 and again == pytest.approx(fitted)
