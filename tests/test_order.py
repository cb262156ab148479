import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.operators.order import average_rank, column_quantiles, from_ordered_bits, grouped_quantiles, ordered_bits, value_ranks, with_places
from fieldlake.operators.screen import incomplete_beta, normal_tail_of_t, two_sided_p

PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def values(seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "smooth":
        return rng.normal(size=3000)
    if kind == "hot":
        return np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000) * 1e6)
    if kind == "wide":
        return 10.0 ** rng.uniform(-300, 298, 3000) * rng.choice([-1, 1], 3000)
    return np.concatenate([rng.normal(size=2990), [1e300, -1e300, 1e-300] * 3, [0.0]])


@pytest.mark.parametrize("kind", ["smooth", "hot", "outliers", "wide"])
def test_narrowed_quantiles_are_exact(spark, kind):
    data = {g: values(i, kind) for i, g in enumerate("ab")}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    got = {(r["g"], r["p"]): r["value"] for r in grouped_quantiles(frame, ["g"], "v", PROBS).collect()}
    wide = spark.createDataFrame([(float(a), float(b)) for a, b in zip(data["a"], data["b"])], "a double, b double")
    columns = {(r["feature"], r["p"]): r["value"] for r in column_quantiles(wide, ["a", "b"], PROBS).collect()}
    assert len(got) == len(PROBS) * 2 and set(columns) == set(got)
    for (g, p), v in got.items():
        want = float(np.quantile(data[g], p))
        assert v == pytest.approx(want, rel=1e-9, abs=1e-12) and columns[g, p] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_ordered_bits_keep_the_order():
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.normal(size=1000) * 10.0 ** rng.integers(-300, 300, 1000), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]]))
    o = ordered_bits(x)
    assert (np.diff(o) >= 0).all() and (np.diff(o)[np.diff(x) > 0] > 0).all() and (from_ordered_bits(o) == x).all()


def test_column_quantiles_skip_empty_columns(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in column_quantiles(frame, ["a", "b"], [0.5]).collect()] == [("a", 0.5, 2.0)]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([0, 0, 0, rng.randrange(50), rng.random()]))) for g in "xy" for _ in range(800)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for r in value_ranks(frame, ["g"], "v").collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert (r["cnt"], r["before"], r["n"]) == (mine.count(r["v"]), sum(v < r["v"] for v in mine), len(mine))
    total = {g: 0.0 for g in "xy"}
    for r in average_rank(frame, ["g"], "v").collect():
        total[r["g"]] += r["avg_rank"] * r["cnt"]
    assert total == {g: 800 * 801 / 2 for g in "xy"}


def test_places_of_hot_values_across_ranges(spark):
    rows = [("g", 0.0 if i < 4000 else float(i), i) for i in range(6000)] + [(None, 5.0, i) for i in range(700)] + [("h", None, 1), ("h", 2.0, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, id int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_places(frame, ["g"], "v", prefix="x_")
        got = out.collect()
        pieces = frame.filter("v = 0").repartitionByRange("g", "v", F.xxhash64("g", "v", "id")).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert pieces > 1 and out.columns == ["g", "v", "id", "x_cnt", "x_before", "x_n"]
    assert len(got) == 6701
    for r in got:
        if r["g"] is None:
            want = (700, 0, 700)
        elif r["g"] == "h":
            want = (1, 0, 1)
        else:
            want = (4000, 0, 6000) if r["v"] == 0 else (1, r["id"], 6000)
        assert (r["x_cnt"], r["x_before"], r["x_n"]) == want


def test_places_with_weights_and_no_rows(spark):
    frame = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 5), ("b", 1.0, 2)], "g string, v double, c bigint")
    got = {(r["g"], r["v"]): (r["cnt"], r["before"], r["n"]) for r in with_places(frame, ["g"], "v", "c").collect()}
    assert got == {("a", 1.0): (3, 0, 8), ("a", 2.0): (5, 3, 8), ("b", 1.0): (2, 0, 2)}
    assert with_places(frame.limit(0), ["g"], "v", "c").count() == 0


def test_t_tails_meet_at_large_degrees_of_freedom():
    for dof in (1e5, 1e6, 1e8):
        for t in (0.01, 0.7, 2.0, 5.0, 12.0):
            assert normal_tail_of_t(t, dof) == pytest.approx(incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)), rel=1e-6)
    assert two_sided_p(2.0, 1e13) == pytest.approx(0.0455002638963584, rel=1e-9)
