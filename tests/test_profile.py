import pytest

from fieldlake.operators import linear as L
from fieldlake.operators import models as M
from fieldlake.operators.profile import data_profile


def test_profile_of_odd_tables(spark):
    kind = "row_id bigint, y double, T2M__mean double, fp_Season string"
    rows = [(1, 2.0, None, "a"), (2, 2.0, 1.0, "a"), (3, None, 1.0, None)]
    tables = data_profile(spark.createDataFrame(rows, kind), "y", "fp_Season", ("row_id",), ("T2M__mean",))
    assert {r.feature: r.missing for r in tables["missing"].collect()} == {"y": 1, "T2M__mean": 1, "fp_Season": 1}
    assert [(r.family, r.n_features, r.n_selected) for r in tables["families"].collect()] == [("Meteorology", 1, 1)]
    assert tables["target_quantiles"].count() == 2 and sum(r.n for r in tables["target_histogram"].collect()) == 2
    assert {r["fp_Season"]: r["median"] for r in tables["target_by_group"].collect() if r["fp_Season"]} == {"a": 2.0}
    empty = data_profile(spark.createDataFrame([], kind), "y", "no such column", ("row_id",))
    assert "target_by_group" not in empty and empty["target"].first().n == 0
    assert [t.count() for n, t in sorted(empty.items()) if n in ("target_histogram", "target_quantiles")] == [0, 0]


def test_attribution_of_linear_and_other_models(spark):
    frame = spark.createDataFrame([(i, 3.0 * i, float(i), float(i % 2)) for i in range(40)], "row_id bigint, y double, a double, b double")
    forest = M.fit_all(frame, [M.rf_spec(trees=3, depth=3, min_rows=1)], ["a", "b"], "y", "row_id")["random_forest"]
    out = M.attribution({"line": L.LineModel([3.0, 0.0], 0.0), "forest": forest}, frame, ["a", "b"], "y", "row_id").collect()
    got = {(r.model, r.feature): (r.importance, r.shapley) for r in out}
    assert got["line", "a"][0] > 1 and got["line", "a"][1] == pytest.approx(30.0) and got["line", "b"] == (0.0, 0.0)
    assert got["forest", "a"][0] > 1 and got["forest", "a"][1] is None and len(got) == 4
