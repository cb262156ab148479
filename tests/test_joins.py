import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldlake.operators.joins import (
    EARTH_RADIUS_M, asof_earliest, asof_nearest, buffer_join, build_master, covered_cells, in_covered_cells, merge_source, window_join, with_cell,
)
from fieldlake.operators.keyed import collapse_duplicates, dedup_first, first_non_null, interpolate_linear
from fieldlake.plans.fetch import build_fetch_plan, pair_with_mapping
from fieldlake.plans.requests import sar_requests, terrain_requests
from fieldlake.session import cut_lineage, salted_join
from fieldlake.sources.scenes import write_pixels
from fieldlake.stages.common import in_extent, place_boxes

DAY = dt.date(2020, 7, 15)


def days(*offsets):
    return [DAY + dt.timedelta(days=o) for o in offsets]


def sides(spark, offsets):
    anchors = spark.createDataFrame([(1, DAY)], "loc int, anchor_date date")
    obs = spark.createDataFrame([(1, d, float(o)) for d, o in zip(days(*offsets), offsets)], "loc int, obs_date date, value double")
    return anchors, obs


def test_window_ends(spark):
    anchors, obs = sides(spark, [-16, -15, 0, 15, 16])
    closed = {r["value"] for r in window_join(anchors, obs, ["loc"], 15, 15).collect()}
    left = {r["value"] for r in window_join(anchors, obs, ["loc"], 15, 15, "left").collect()}
    same_day = {r["value"] for r in window_join(anchors, obs, ["loc"], 0, 1, "left").collect()}
    assert closed == {-15.0, 0.0, 15.0} and left == {-15.0, 0.0} and same_day == {0.0}


def test_window_join_equals_brute_force(spark):
    rng = random.Random(1)
    anchors = [(rng.randrange(3), DAY + dt.timedelta(days=rng.randrange(-40, 40)), i) for i in range(60)]
    # One location holds most of the observations.
    obs = [(rng.choice([0, 0, 0, 1, 2]), DAY + dt.timedelta(days=rng.randrange(-60, 60)), i) for i in range(300)]
    got = window_join(
        spark.createDataFrame(anchors, "loc int, anchor_date date, a int"), spark.createDataFrame(obs, "loc int, obs_date date, o int"), ["loc"], 4, 9
    ).select("a", "o").collect()
    want = {(a[2], o[2]) for a in anchors for o in obs if a[0] == o[0] and -4 <= (o[1] - a[1]).days <= 9}
    assert {(r["a"], r["o"]) for r in got} == want and len(got) == len(want)


def test_asof_ties_and_order(spark):
    anchors, obs = sides(spark, [-3, 3, 7])
    assert asof_nearest(anchors, obs, ["loc"], 15, ["value"]).first()["value"] == -3.0
    assert asof_earliest(anchors, obs, ["loc"], 15, ["value"]).first()["value"] == -3.0
    anchors, obs = sides(spark, [-9, 1])
    assert asof_nearest(anchors, obs, ["loc"], 15, ["value"]).first()["value"] == 1.0
    assert asof_earliest(anchors, obs, ["loc"], 15, ["value"]).first()["value"] == -9.0


def metres(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))


@pytest.mark.parametrize("centre", [(0.0, 0.0), (60.0, 10.0), (10.0, 180.0), (-45.0, -179.9999), (89.995, 50.0), (-89.999, 0.0)])
def test_buffer_join_equals_brute_force(spark, centre):
    rng = random.Random(7)
    points = [centre]
    wide = min(0.02 / max(math.cos(math.radians(centre[0])), 1e-3), 180.0)
    pixels = []
    for i in range(400):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-0.02, 0.02)))
        lon = (centre[1] + rng.uniform(-wide, wide) + 180.0) % 360.0 - 180.0
        pixels.append((i, lat, lon))
    places = spark.createDataFrame(points, "latitude double, longitude double")
    table = spark.createDataFrame(pixels, "id int, lat double, lon double")
    want = {p[0] for p in pixels if metres(centre, p[1:]) <= 900.0}
    for broadcast in (None, False):
        got = buffer_join(places, table, 900.0, broadcast=broadcast).collect()
        assert {r["id"] for r in got} == want and len(got) == len(want) and want


def test_pixels_near_any_point_come_once_and_unshuffled(spark):
    rng = random.Random(8)
    centres = [(10.0 + i * 1e-3, 20.0) for i in range(30)] + [(-50.0, -170.0 + i) for i in range(30)]
    places = spark.createDataFrame(centres, "latitude double, longitude double")
    pixels = [(i, *(c + rng.uniform(-0.02, 0.02) for c in rng.choice(centres))) for i in range(2000)]
    table = spark.createDataFrame(pixels, "id int, lat double, lon double")
    want = sorted(p[0] for p in pixels if any(metres(c, p[1:]) <= 300.0 for c in centres))
    for broadcast in (None, False):
        near = buffer_join(places, table, 300.0, how="left_semi", broadcast=broadcast)
        assert near.columns == table.columns and sorted(r["id"] for r in near.collect()) == want
    assert "Exchange hashpartitioning" not in buffer_join(places, table, 300.0)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        buffer_join(places, table, 300.0, how="left_anti")


@pytest.mark.parametrize("limit", [1, 7, 100_000])
def test_coarser_cells_lose_no_pixel(spark, limit):
    rng = random.Random(9)
    places = spark.createDataFrame([(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(40)], "latitude double, longitude double")
    covered = covered_cells(places, 5000.0).cache()
    near = places.select(F.monotonically_increasing_id().alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    far = spark.createDataFrame([(10**12 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(500)], "id bigint, lat double, lon double")
    left = in_covered_cells(with_cell(near.union(far), 5000.0), covered, limit)
    assert left.filter("id < 1000000000000").count() == 40
    if limit > 7:
        assert left.count() < 100


def test_boxes_hold_all_places(spark):
    rng = random.Random(10)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    boxes = place_boxes(spark.createDataFrame(spots, "latitude double, longitude double"))
    assert 1 < len(boxes) <= 32
    assert all(any(s <= lat <= n and w <= lon <= e for s, n, w, e in boxes) for lat, lon in spots)
    apart = spark.createDataFrame([(10.0, 10.0), (-30.0, 140.0)], "latitude double, longitude double")
    pixels = spark.createDataFrame([(10.0, 10.0), (-30.0, 140.0), (0.0, 60.0), (10.0, 140.0)], "lat double, lon double")
    assert in_extent(apart, pixels, 1000.0).count() == 2 and in_extent(apart.limit(0), pixels, 1000.0).count() == 0


def test_clustered_pixels_keep_all_rows(spark, tmp_path):
    rng = random.Random(11)
    pixels = spark.createDataFrame([(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(3000)], "id int, lat double, lon double")
    write_pixels(pixels, str(tmp_path / "pixels"), 10_000.0)
    back = spark.read.parquet(str(tmp_path / "pixels"))
    assert back.columns == pixels.columns and back.exceptAll(pixels).count() == 0 and back.count() == 3000


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 10)).alias("k"), "id")
    small = spark.createDataFrame([(k, k * k) for k in range(5)], "k bigint, v bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert salted_join(big, small, ["k"], how).count() == big.join(small, ["k"], how).count()
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "full_outer")


def test_large_mapping_gives_the_same_plan(spark):
    fields = spark.createDataFrame([(i,) for i in range(20)], "f int")
    mapping = spark.createDataFrame([(f"v{i}", i) for i in range(30)], "variable string, n int")
    inline = {tuple(r) for r in pair_with_mapping(fields, mapping).collect()}
    joined = {tuple(r) for r in pair_with_mapping(fields, mapping, inline_rows=10).collect()}
    assert inline == joined and len(inline) == 600
    assert pair_with_mapping(fields, mapping.limit(0)).count() == 0


def test_mapping_of_several_blocks_is_not_shuffled(spark):
    fields = spark.range(3).withColumnRenamed("id", "f")
    mapping = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("variable"))
    plan = pair_with_mapping(fields, mapping)
    assert plan.distinct().count() == plan.count() == 15_000
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_plan_drops_duplicate_fields_and_mapping_rows(spark):
    fields = spark.createDataFrame([(DAY, 1.0, 2.0, 5, "b"), (DAY, 1.0, 2.0, 3, "a"), (DAY, 1.0, 3.0, 9, "c")], "date date, latitude double, longitude double, id int, x string")
    mapping = spark.createDataFrame([("NDVI", "B4"), ("NDVI", "B4"), ("EVI", "B4")], "variable string, `api parameter` string")
    plan = build_fetch_plan(fields, mapping, ["id"])
    assert plan.count() == 4 and {r["id"] for r in plan.collect()} == {3, 9}


def plan_of(spark, api, variable):
    return spark.createDataFrame([(DAY, 40.7, -74.0, api, variable)], "date date, latitude double, longitude double, `api parameter` string, variable string")


def test_request_rules(spark):
    assert sar_requests(plan_of(spark, "Derived", "S1 VV/VH ratio (linear σ⁰)")).first()["groups"] == ["VH", "VV", "VVVH_ratio"]
    assert sar_requests(plan_of(spark, "nothing", "here")).first()["groups"] == ["RVI", "VH", "VV", "VVVH_ratio"]
    assert terrain_requests(plan_of(spark, "Derived", "elevation, slope, aspect, hillshade")).first()["bands"] == ["elevation", "slope", "aspect", "hillshade"]
    assert terrain_requests(plan_of(spark, "slope_mean", "x")).first()["bands"] == ["slope"]


def test_master_equals_chain_of_merges(spark):
    def frame(rows, name):
        return spark.createDataFrame([(DAY, float(k), 0.0, v) for k, v in rows], f"date date, latitude double, longitude double, {name} double")

    a, b, c = frame([(1, 1.0), (2, 2.0)], "x"), frame([(2, 5.0), (3, 6.0)], "x"), frame([(1, 7.0), (4, 8.0)], "z")
    chain = merge_source(merge_source(a, b, "_s2"), c, "_s1")
    union = build_master([(a, ""), (b, "_s2"), (c, "_s1")])
    assert chain.columns == union.columns
    assert {tuple(r) for r in chain.collect()} == {tuple(r) for r in union.collect()}
    assert merge_source(a, c.limit(0), "_s1").columns == a.columns


def test_row_choice(spark):
    rows = spark.createDataFrame([(1, 3, None, "c"), (1, 1, None, "a"), (1, 2, 5, None)], "k int, o int, n int, s string")
    assert tuple(dedup_first(rows, ["k"], ["o"]).first()) == (1, 1, None, "a")
    assert tuple(first_non_null(rows, ["k"], ["o"]).first()) == (1, 5, "a")
    assert collapse_duplicates(rows, ["k"]).first()["o"] in (1, 2, 3)
    full = spark.createDataFrame([(1, None, "x"), (1, 4, "y")], "k int, n int, s string")
    assert tuple(collapse_duplicates(full, ["k"]).first()) == (1, 4, "y")


def test_interpolation_by_position_and_ends(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "p string, i int, v double")
    out = interpolate_linear(rows, ["v"], ["p"], ["i"]).orderBy("i").collect()
    assert [r["v"] for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_cut_lineage_round_trip(spark):
    frame = spark.createDataFrame([(1, "a b", 2.0)], "id int, `odd (name / x)` string, T2M__max double")
    assert [tuple(r) for r in cut_lineage(frame).collect()] == [(1, "a b", 2.0)]


def test_master_takes_whole_rows_where_keys_meet(spark):
    a = spark.createDataFrame(
        [("2020-01-01", 40.00000011, 1.0, 1, 9), ("2020-01-01", 40.00000012, 1.0, 5, 2), ("2020-01-01", 41.0, 1.0, 7, None), ("2020-01-01", 41.0, 1.0, 3, 4)],
        "date string, latitude double, longitude double, x int, y int")
    got = {r["latitude"]: (r["x"], r["y"]) for r in build_master([(a, "")], unique=True).collect()}
    assert got == {40.0: (5, 2), 41.0: (3, 4)}
