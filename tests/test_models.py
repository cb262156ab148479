from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.operators import models as M
from fieldlake.operators import screen as S
from fieldlake.operators.profile import corr_matrix, normal_quantile, normal_reference, qq_points


def test_folds_do_not_depend_on_partitions(spark):
    frame = spark.range(500).withColumnRenamed("id", "row_id")
    one = {r["row_id"]: r["fold"] for r in M.kfold(frame.repartition(1), "row_id").collect()}
    many = {r["row_id"]: r["fold"] for r in M.kfold(frame.repartition(8), "row_id").collect()}
    assert one == many and set(one.values()) == set(range(5)) and len(one) == 500


def test_no_group_in_two_folds(spark):
    frame = spark.range(400).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 23).alias("g"))
    out = M.group_kfold(frame, ["g"], 4).collect()
    folds = {}
    for r in out:
        folds.setdefault(r["g"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values()) and len(out) == 400
    sizes = Counter(r["fold"] for r in out)
    assert len(sizes) == 4 and max(sizes.values()) == Counter(r["g"] for r in out)[0]


def test_shuffled_column_is_a_permutation(spark):
    frame = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") * 2).cast("double").alias("x"))
    out = M.permuted(frame, "x", "row_id", groups=4).collect()
    assert sorted(r["x"] for r in out) == [2.0 * i for i in range(300)]
    assert sum(r["x"] == 2.0 * r["row_id"] for r in out) < 5


def test_blend_respects_floor_and_sum(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=400)
    data = [(float(v), float(v + e1), float(v + e2), float(9 - v)) for v, e1, e2 in zip(y, rng.normal(size=400), rng.normal(size=400) * 2)]
    frame = spark.createDataFrame(data, "y double, a double, b double, svm double")
    w = M.blend_weights(frame, "y", ["a", "b", "svm"], {"svm": 0.05})
    assert sum(w.values()) == pytest.approx(1.0) and w["svm"] >= 0.05 - 1e-9 and min(w.values()) >= -1e-9
    errors = M.blend_errors(frame, "y", ["a", "b", "svm"], [tuple(w.values()), (1 / 3,) * 3, (0.9, 0.05, 0.05)]).orderBy("id").collect()
    assert errors[0]["mae"] <= min(errors[1]["mae"], errors[2]["mae"]) + 1e-9


@pytest.mark.parametrize("t, dof, p", [(2.0, 10, 0.07338803477074037), (0.0, 5, 1.0), (-3.5, 30, 0.001475), (1.96, 1_000_000, 0.0499961)])
def test_student_p_values(t, dof, p):
    assert S.two_sided_p(t, dof) == pytest.approx(p, rel=2e-3)


def test_association_of_flat_and_short_features(spark):
    frame = spark.createDataFrame([(1.0, float(i), 7.0, None if i else 1.0) for i in range(10)], "k double, y double, flat double, short double")
    out = {r["feature"]: r for r in S.association(frame.withColumn("x", F.col("y") * -2), ["x", "flat", "short"], "y").collect()}
    assert out["x"]["pearson"] == pytest.approx(-1.0) and out["x"]["spearman"] == pytest.approx(-1.0) and out["x"]["pearson_p"] < 1e-6
    for name in ("flat", "short"):
        assert (out[name]["pearson"], out[name]["pearson_p"], out[name]["spearman_p"]) == (0.0, 1.0, 1.0)


def test_correlation_paths_agree(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(200, 18)) + rng.normal(size=(200, 1)) + 1e4
    rows = [[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(data)]
    names = [f"c{j}" for j in range(18)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    many = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, names).collect()}
    few = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, names[:6]).collect()}
    assert len(many) == 153
    assert all(many[k] == pytest.approx(v, abs=1e-9) for k, v in few.items())


def test_normal_quantile(spark):
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999):
        assert spark.range(1).select(normal_quantile(F.lit(p)).alias("z")).first()["z"] == pytest.approx(normal_reference(p), abs=1e-7)


def test_qq_points_cover_every_row_once(spark):
    frame = spark.createDataFrame([(float(v),) for v in (3, 1, 1, 2, 9)], "x double")
    out = qq_points(frame, "x").orderBy("i").collect()
    assert [(r["i"], r["value"]) for r in out] == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0), (5, 9.0)]
    assert out[2]["normal"] == pytest.approx(0.0, abs=1e-9)


def test_selection_covers_families_and_avoids_copies(spark):
    scores = spark.createDataFrame([("a", 1.0), ("a2", 0.9), ("b", 0.5), ("c", 0.4)], "feature string, relevance double")
    corr = spark.createDataFrame([("a", "a2", 0.99), ("a", "b", 0.1), ("a", "c", 0.1), ("a2", "b", 0.1), ("a2", "c", 0.1), ("b", "c", 0.0)], "a string, b string, r double")
    assert S.mrmr_select(scores, corr, {"one": ["c"]}, 3) == ["c", "a", "b"]
    assert S.mrmr_select(scores, corr, {}, 4) == ["a", "b", "c", "a2"]


def test_interactions_need_four_whole_features(spark):
    frame = spark.createDataFrame([(float(i), float(i * i), None) for i in range(9)], "y double, a double, b double")
    with pytest.raises(ValueError, match="gap-free"):
        S.interaction_columns(frame, "y")


def test_fold_runs_are_the_greedy_walk():
    import random

    from fieldlake.operators.models import fold_runs

    rng = random.Random(1)
    for _ in range(200):
        k = rng.randint(1, 6)
        sizes = [(n, rng.randint(1, 30)) for n in sorted({rng.randint(1, 60) for _ in range(rng.randint(1, 8))}, reverse=True)]
        load, want = [0] * k, []
        for n, count in sizes:
            for place in range(count):
                lightest = min(range(k), key=lambda f: load[f])
                load[lightest] += n
                want.append((n, place, lightest))
        got = [(n, p, turns[(p - a) % len(turns)]) for n, a, b, turns in fold_runs(sizes, k) for p in range(a, b + 1)]
        assert sorted(got) == sorted(want)


def test_correlations_of_gaps_that_never_meet(spark):
    rows = [(float(i), None, float("nan"), 1.0) if i % 2 else (None, float(i), float(i), 1.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    wide = frame.select("*", *(frame["a"].alias(f"a{i}") for i in range(20)))
    for f in (frame, wide):
        got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(f, f.columns).collect()}
        assert got["a", "b"] is None and got["a", "c"] is None and got["a", "d"] is None and got["b", "c"] == pytest.approx(1.0)


def test_row_ids_stay_whole(spark):
    from fieldlake.operators.prep import prepare_model_input

    ids = [2**24, 2**24 + 1, 2**53 + 1, 2**53 + 2]
    out = prepare_model_input(spark.createDataFrame([(i, 1.5) for i in ids], "row_id bigint, x double"))
    assert sorted(r.row_id for r in out.collect()) == ids and dict(out.dtypes) == {"row_id": "bigint", "x": "float"}


def test_stored_state_scores_like_the_one_in_memory(spark, tmp_path):
    from fieldlake.config import ModelConfig
    from fieldlake.operators import models as M
    from fieldlake.operators.prep import Preprocessor
    from fieldlake.operators.score import ScoringState, load_scoring_state, save_scoring_state, score

    rows = [(2**53 + 1 + i, 3.0 * i + i % 5, float(i), None if i % 9 == 0 else float(i % 7)) for i in range(120)]
    frame = spark.createDataFrame(rows, "row_id bigint, target double, T2M__mean double, sand_mean double")
    steps = Preprocessor(ModelConfig(target="target", category_columns=()))
    ready = steps.fit_transform(frame)
    features = ["T2M__mean", "sand_mean"]
    specs = [M.elastic_net_spec(ratios=(0.5,), penalties=(0.01,), inner=2), M.kernel_regression_spec(8, (0.1,), (0.01,))]
    state = ScoringState(steps, features, M.fit_all(ready, specs, features, "target", "row_id"), {s.name: 0.5 for s in specs}, [], None)
    save_scoring_state(state, spark, str(tmp_path / "s"))
    new = load_scoring_state(spark, str(tmp_path / "s"))
    a, b = ({r.row_id: r.prediction for r in score(frame.drop("target"), s)[0].collect()} for s in (state, new))
    assert set(a) == {r[0] for r in rows} and a == pytest.approx(b)


def test_convex_blend_beats_the_refined_grid(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(50, 20, 1500)
    noise = [rng.normal(0, 4, 1500), rng.standard_t(2, 1500) * 3, rng.normal(2, 5, 1500), rng.normal(0, 30, 1500)]
    models = ["a", "b", "c", "svm"]
    frame = spark.createDataFrame([(float(t), *(float(t + n[i]) for n in noise)) for i, t in enumerate(y)], "y double, a double, b double, c double, svm double")
    found = M.convex_blend(frame, "y", models, {"svm": 0.05})
    grid = M.blend_weights(frame, "y", models, {"svm": 0.05})
    assert sum(found.values()) == pytest.approx(1.0) and found["svm"] >= 0.05 - 1e-12 and min(found.values()) >= -1e-12
    mae = {name: float(np.mean(np.abs(sum(w[m] * n for m, n in zip(models, noise))))) for name, w in (("convex", found), ("grid", grid))}
    assert mae["convex"] <= mae["grid"] * (1 + 1e-6)


def test_convex_blend_of_odd_tables(spark):
    kind = "y double, a double, b double"
    assert M.convex_blend(spark.createDataFrame([], kind), "y", ["a", "b"]) == {"a": 0.5, "b": 0.5}
    exact = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 2.0, 9.0), (None, 1.0, 1.0), (4.0, None, 1.0)], kind)
    assert M.convex_blend(exact, "y", ["a", "b"]) == pytest.approx({"a": 1.0, "b": 0.0}, abs=1e-4)
    same = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, 5.0, 5.0)], kind)
    assert sum(M.convex_blend(same, "y", ["a", "b"], {"b": 0.3}).values()) == pytest.approx(1.0)
