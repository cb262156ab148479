import os

from pyspark.sql import functions as F

from fieldlake.operators import screen
from fieldlake.operators.order import column_quantiles
from fieldlake.session import at_once, cut_lineage, shared_dir, short_lived


def written(spark):
    return {d for d in os.listdir(shared_dir(spark).removeprefix("file://")) if d.startswith("fieldlake-")}


def rows(spark):
    x = F.col("id")
    return cut_lineage(spark.range(3000).select((x % 97).cast("double").alias("a"), (x % 31 + x / 500).alias("b"), F.when(x % 7 != 0, x * 1.5).alias("c"), (x % 97 + x / 900).alias("y")))


def test_intermediate_files_go_and_outer_ones_stay(spark):
    before = written(spark)
    with short_lived(spark):
        inner = cut_lineage(spark.range(5))
        with short_lived(spark):
            gone = written(spark) - before
            kept = cut_lineage(inner, outer=True)
        assert kept.count() == 5 and gone <= written(spark)
        lasting = at_once(spark, [lambda: cut_lineage(kept, outer=True), lambda: cut_lineage(kept)])[0]
    assert lasting.count() == 5
    assert len(written(spark) - before) == 1


def test_scores_of_features_ranked_a_few_at_a_time(spark, monkeypatch):
    df, names = rows(spark), ["a", "b", "c"]
    before = written(spark)
    shown = lambda: sorted(map(tuple, screen.feature_scores(df, names, "y", alpha=1.1).collect()))
    whole = shown()
    monkeypatch.setattr(screen, "PAIR_ROWS", 3000, raising=False)
    assert shown() == whole and len(whole) == 3
    column_quantiles(df, names, [0.5]).collect()
    screen.binned_mi(df, names, "y").collect()
    assert written(spark) == before  # nothing that was written for them is left
