import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from fieldlake.operators.keyed import interpolate_linear


def plain(values):
    known = [i for i, v in enumerate(values) if v is not None]
    if not known:
        return values
    return list(np.interp(range(len(values)), known, [values[i] for i in known]))


def test_slices_change_no_filled_value(spark):
    rng = random.Random(5)
    start, rows, want = datetime.date(1998, 3, 1), [], {}
    for place in ("a", "b", None, "all null"):
        days = sorted(rng.sample(range(4000), 60))  # many slices hold no row, others only gaps
        values = [None if place == "all null" or rng.random() < 0.6 else float(rng.randrange(100)) for _ in days]
        rows += [(place, start + datetime.timedelta(d), v, "kept") for d, v in zip(days, values)]
        want |= {(place, start + datetime.timedelta(d)): v for d, v in zip(days, plain(values))}
    frame = spark.createDataFrame(rows, "place string, day date, v double, other string")
    for cut in (None, F.lit(0), F.unix_date("day")):
        out = interpolate_linear(frame, ["v"], ["place"], ["day"], cut)
        assert out.columns == frame.columns and out.count() == len(rows)
        for r in out.collect():
            w = want[r["place"], r["day"]]
            assert (w is None and r["v"] is None) or abs(r["v"] - w) < 1e-9


def test_a_long_history_is_spread(spark):
    days = spark.range(20_000).select(F.lit("one").alias("place"), F.date_add(F.lit("1970-01-01"), F.col("id").cast("int")).alias("day"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    out = interpolate_linear(days, ["v"], ["place"], ["day"])
    low = out.filter(F.abs(F.col("v") - F.least(F.unix_date("day"), F.lit(19_000))) > 1e-6)
    assert out.count() == 20_000 and low.count() == 0
