import pytest
from pyspark.sql import functions as F

from fieldlake.operators import prep as P


def test_codes_of_many_levels(spark):
    frame = spark.range(300_000).select("id", F.concat(F.lit("level-"), F.hash("id").cast("string"), F.lit("-"), "id").alias("c"))
    state = P.label_encode_fit(frame.filter("id % 4 <> 0"), ["c"])
    assert state.rdd.getNumPartitions() > 1
    out = P.label_encode_apply(frame, state, ["c"]).toPandas()
    known = out[out["id"] % 4 != 0].sort_values("c")
    fresh = out[out["id"] % 4 == 0].sort_values("c")
    assert known["c__code"].tolist() == list(range(225_000)) and fresh["c__code"].tolist() == list(range(225_000, 300_000))


def test_codes_of_odd_columns(spark):
    frame = spark.createDataFrame([("b", 1), ("", 2), (None, 2), ("b", None)], "c string, n int")
    out = P.label_encode_apply(frame, P.label_encode_fit(frame, ["c", "n"]), ["c", "n"])
    assert out.columns == ["c", "n", "c__code", "n__code"]
    assert sorted((r.c or "-", r.n or 0, r["c__code"], r["n__code"]) for r in out.collect()) == [("-", 2, 0, 1), ("-", 2, 1, 1), ("b", 0, 2, 2), ("b", 1, 2, 0)]
    none = frame.limit(0)
    assert P.label_encode_apply(none, P.label_encode_fit(none, ["c"]), ["c"]).count() == 0
    late = P.label_encode_apply(frame, P.label_encode_fit(none, ["c"]), ["c"]).collect()
    assert {r["c__code"] for r in late} == {0, 1, 2}


def test_one_hot_of_many_levels_is_hashed(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("Site(x)"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("string").alias("few"))
    state = P.one_hot_fit(frame, ["Site(x)", "few", "absent"], max_levels=100, buckets=16)
    out = P.one_hot_apply(frame, state)
    assert out.columns == [*(f"Site_hash_{b}" for b in range(16)), "few_2", "few_3", "few_4"]
    hashed = [f"`Site_hash_{b}`" for b in range(16)]
    rows = out.select(sum(F.expr(h) for h in hashed).alias("n"), *hashed).toPandas()
    assert (rows["n"] == 1).all() and (rows.drop(columns="n").sum() > 10).all()
    other = spark.createDataFrame([(None, "2"), ("unseen", None)], "`Site(x)` string, few string")
    made = P.one_hot_apply(other, state).select(sum(F.expr(h) for h in hashed).alias("n"), "few_2").collect()
    assert sorted(map(tuple, made)) == [(0, 1), (1, 0)]
    exact = P.one_hot_fit(frame, ["Site(x)"], max_levels=500)
    assert exact.count() == 499 and exact.filter("level is null").count() == 0
