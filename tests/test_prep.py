import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.config import ModelConfig
from fieldlake.operators import impute as I
from fieldlake.operators import neighbours as N
from fieldlake.operators import prep as P


def rows(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def test_winsorise_twice_is_once(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(200)] + [(None,)], "x double")
    state = P.winsor_fit(frame, ["x"])
    once = P.winsor_apply(frame, state)
    assert sorted(rows(once, "x"), key=str) == sorted(rows(P.winsor_apply(once, state), "x"), key=str)
    assert once.filter("x is null").count() == 1


def test_exact_median_and_zero_spread(spark):
    frame = spark.createDataFrame([(v, 5.0) for v in (1.0, 2.0, 4.0, 9.0)], "x double, flat double")
    assert {r["feature"]: r["median"] for r in P.median_impute_fit(frame, ["x"]).collect()} == {"x": 3.0}
    scaled = P.robust_scale_apply(frame.withColumn("flat", F.col("flat") + 1), P.robust_scale_fit(frame, ["x", "flat"]))
    assert {r["flat"] for r in scaled.collect()} == {1.0}


def test_unseen_labels_follow_the_known_ones(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("z",), ("a",), ("y",), (None,)], "c string")
    out = P.label_encode_apply(test, P.label_encode_fit(train, ["c"]), ["c"])
    assert dict(rows(out, "c", "c__code")) == {None: 0, "a": 1, "y": 3, "z": 4}


def test_one_hot_drops_first_and_aligns(spark):
    train = spark.createDataFrame([("SA", "D"), ("WS", "T")], "`Season(x)` string, I string")
    state = P.one_hot_fit(train, ["Season(x)", "I"])
    out = P.one_hot_apply(spark.createDataFrame([("WS",), ("new",)], "`Season(x)` string"), state)
    assert out.columns == ["I_T", "Season_WS"]
    assert rows(out, "Season_WS", "I_T") == [(1, 0), (0, 0)]


def test_null_guard_names_the_columns(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError, match=r"b \(50"):
        P.assert_no_nulls(frame, ["a", "b"])
    assert P.assert_no_nulls(frame, ["a"]).count() == 2


def brute_knn(data, i, j, k=5):
    found = []
    for d, row in enumerate(data):
        if math.isnan(row[j]):
            continue
        both = [c for c in range(len(row)) if not math.isnan(row[c]) and not math.isnan(data[i][c])]
        if both:
            found.append((sum((row[c] - data[i][c]) ** 2 for c in both) * len(row) / len(both), d))
    return float(np.mean([data[d][j] for _, d in sorted(found)[:k]]))


@pytest.mark.parametrize("chunk", [7, 4096])
def test_neighbours_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(11)
    data = rng.integers(0, 9, size=(60, 3)).astype(float)
    data[rng.random(60) < 0.3, 0] = np.nan
    data[rng.random(60) < 0.2, 1] = np.nan
    frame = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)], "row_id bigint, a double, b double, c double")
    out = {r["row_id"]: r for r in P.knn_impute(frame, ["a", "b"], ["c"], "row_id", chunk=chunk).collect()}
    assert len(out) == 60
    for i, row in enumerate(data):
        for j, name in enumerate("ab"):
            want = brute_knn(data, i, j) if math.isnan(row[j]) else row[j]
            assert out[i][name] == pytest.approx(want)


def test_unblocked_neighbours_visit_few_chunks(spark):
    """Equal to all pairs with ties, repeated rows, text ids and donors of several patterns; far fewer rows are met."""
    rng = np.random.default_rng(4)
    data = np.round(rng.normal(size=(1500, 3)) * 20) / 2
    data[rng.random(1500) < 0.1, 0] = np.nan
    data[rng.random(1500) < 0.05, 2] = np.nan
    data[1000:1300] = data[0]
    ids = [f"r{i:05d}" for i in range(len(data))]
    frame = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in zip(ids, data)], "row_id string, a double, b double, c double")
    out = {r["row_id"]: r for r in P.knn_impute(frame, ["a"], ["b", "c"], "row_id", chunk=32).collect()}
    for i in np.flatnonzero(np.isnan(data[:, 0])):
        assert out[ids[i]]["a"] == pytest.approx(brute_knn(data, i, 0)), i
    assert all(out[ids[i]]["a"] == data[i, 0] for i in np.flatnonzero(~np.isnan(data[:, 0])))
    chunks = N.donor_chunks(frame, "row_id", [], ["a", "b", "c"], 5, 32)
    assert chunks.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 32
    assert chunks.groupBy("chunk").agg(F.countDistinct("_pattern").alias("n")).agg(F.max("n")).first()[0] == 1
    assert chunks.filter("_a0 is not null").count() < 1300  # of equal donors the five smallest ids stay


def test_neighbours_of_odd_tables(spark):
    schema = "row_id bigint, blk string, a double, b double"
    frame = spark.createDataFrame([(1, "x", None, 1.0), (2, "x", 5.0, None), (3, None, 7.0, 1.0), (4, None, float("nan"), 1.0), (5, "y|", None, None)], schema)
    out = {r["row_id"]: r["a"] for r in P.knn_impute(frame, ["a"], ["b"], "row_id", ["blk"]).collect()}
    assert out == {1: 6.0, 2: 5.0, 3: 7.0, 4: 7.0, 5: 6.0}  # without usable donors: the column's mean
    assert P.knn_impute(frame.limit(0), ["a"], ["b"], "row_id", ["blk"]).count() == 0


def test_bayesian_ridge_finds_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=500) * 0.01
    z = np.column_stack([x - x.mean(0), y - y.mean()])
    assert I.bayesian_ridge(500.0, z.T @ z) == pytest.approx([2.0, -1.0], abs=1e-2)


def test_iterative_imputation_recovers_a_linear_column(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(a), float(b), None if i % 5 == 0 else float(3 * a - b + 1)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    frame = spark.createDataFrame(data, "row_id bigint, a double, b double, c double")
    columns = ["a", "b", "c"]
    out = P.iterative_impute_apply(frame, P.iterative_impute_fit(frame, columns), columns).collect()
    assert all(r["c"] == pytest.approx(3 * r["a"] - r["b"] + 1, abs=0.05) for r in out)


def plain_iterative(x, rounds, tol):
    """Row by row: every gap column regressed on the others in turn, columns with fewer gaps first."""
    gap, scale = np.isnan(x), tol * np.nanmax(np.abs(x))
    filled = np.where(gap, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        largest = 0.0
        for c in sorted((c for c in range(x.shape[1]) if gap[:, c].any()), key=lambda c: (gap[:, c].mean(), c)):
            inputs = [i for i in range(x.shape[1]) if i != c]
            known = filled[~gap[:, c]][:, [*inputs, c]]
            mean = known.mean(axis=0)
            w = I.bayesian_ridge(float(len(known)), (known - mean).T @ (known - mean))
            guess = (filled[gap[:, c]][:, inputs] - mean[:-1]) @ w + mean[-1]
            largest = max(largest, np.max(np.abs(guess - filled[gap[:, c], c])))
            filled[gap[:, c], c] = guess
        if largest < scale:
            break
    return filled


@pytest.mark.parametrize("pattern_bytes", [1 << 28, 0])
@pytest.mark.parametrize("rounds, tol", [(3, 0.0), (10, 1e-3)])
def test_pattern_moments_equal_row_by_row_fits(spark, pattern_bytes, rounds, tol):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + [1000.0, -3.0, 0.0, 50.0]
    x[rng.random(x.shape) < [0.2, 0.1, 0.3, 0.0]] = np.nan
    columns = ["a", "b", "c", "d"]
    frame = spark.createDataFrame([(2**60 + i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, a double, b double, c double, d double")
    state = I.iterative_impute_fit(frame, columns, rounds, tol, pattern_bytes)
    out = {r["row_id"]: [r[c] for c in columns] for r in I.iterative_impute_apply(frame, state, columns).collect()}
    assert np.allclose([out[2**60 + i] for i in range(400)], plain_iterative(x, rounds, tol), rtol=1e-9, atol=1e-9)


def test_iterative_imputation_of_odd_columns(spark):
    rows = [(None, 1.0, None), (2.0, None, None), (float("nan"), 3.0, None), (4.0, 4.0, None)]
    frame = spark.createDataFrame(rows, "a double, b double, empty double")
    out = I.iterative_impute_apply(frame, I.iterative_impute_fit(frame, frame.columns), frame.columns).collect()
    assert len(out) == 4 and all(math.isfinite(v) for r in out for v in r) and {r["empty"] for r in out} == {0.0}
    none = frame.limit(0)
    assert I.iterative_impute_apply(none, I.iterative_impute_fit(none, none.columns), none.columns).count() == 0
    assert I.iterative_impute_apply(frame, I.iterative_impute_fit(frame, ["a"]), ["a"]).filter("a is null").count() == 0


def test_preprocessor_replays_on_new_rows(spark):
    cfg = ModelConfig(target="y", category_columns=("fp_Area",))
    data = [(i, float(i), None if i % 4 == 0 else float(i % 7), None if i % 6 == 0 else float(i % 5), "ab"[i % 2]) for i in range(60)]
    schema = "row_id bigint, y double, NDVI__mean double, sand_0 double, fp_Area string"
    steps = P.Preprocessor(cfg)
    fitted = steps.fit_transform(spark.createDataFrame(data, schema))
    fresh = steps.transform(spark.createDataFrame([(99, 1.0, None, None, "zz")], schema))
    assert fitted.columns == fresh.columns and fresh.first()["fp_Area_b"] == pytest.approx(-0.5)
    assert all(v is not None for v in fresh.first())
