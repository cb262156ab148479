"""Reports on a table: gaps, target, correlations, distributions, families."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import FAMILIES, in_family
from fieldlake.naming import col
from fieldlake.operators.order import grouped_quantiles, unpivot, value_ranks
from fieldlake.operators.zonal import STATS



def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [name for name, kind in df.dtypes if kind in kinds or kind.startswith("decimal")]


def _tall(df: DataFrame, columns: list[str], per_column: dict[str, object], name: str = "feature") -> DataFrame:
    """One aggregate row of structs, turned into one row per column.

    ``per_column`` maps an output name to a function column -> aggregate.
    """
    cells = [
        F.struct(F.lit(c).alias(name), *(make(col(c)).alias(out) for out, make in per_column.items())).alias(f"_c{i}")
        for i, c in enumerate(columns)
    ]
    one = df.agg(*cells)
    return one.select(F.explode(F.array(*(F.col(f"_c{i}") for i in range(len(columns))))).alias("_s")).select("_s.*")


def missing_report(df: DataFrame, columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Missing count and percentage per column; ``top`` keeps the worst k with any gap."""
    columns = columns or df.columns
    report = _tall(df, columns, {
        "missing": lambda c: F.count_if(c.isNull()),
        "pct": lambda c: F.count_if(c.isNull()).cast("double") / F.count("*") * 100,
    })
    if top is None:
        return report
    return report.filter("missing > 0").orderBy(F.col("pct").desc(), F.col("feature")).limit(top)


def missing_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Missing percentage of each column within each group: group, feature, pct."""
    shares = [(F.count_if(col(c).isNull()).cast("double") / F.count("*") * 100).alias(c) for c in columns]
    wide = df.groupBy(col(group)).agg(*shares)
    return wide.unpivot([col(group)], [col(c) for c in columns], "feature", "pct")


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample deviation, extremes, bias-corrected skewness and excess kurtosis, normality p-value."""
    v = col(target).cast("double")
    moments = df.agg(
        F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
    )
    n, g1, g2 = F.col("n"), F.col("_g1"), F.col("_g2")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    return moments.select(
        F.col("n").cast("bigint").alias("n"), "mean", "std", "min", "max",
        skew.alias("skewness"), kurt.alias("kurtosis"), F.exp(-jb / 2).alias("jarque_bera_p"),
    )


# ---- correlation ----------------------------------------------------------

def finite(x: Column) -> Column:
    """Known, and neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def pair_corr(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known numbers; null when either is constant (``corr`` would fail)."""
    both = finite(x) & finite(y)
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations as rows (a, b, r), a before b in column order.

    Each task reduces its rows to the pair sums with matrix products, and the
    sums are added up. NaN and infinite values count as unknown; a pair never
    known together, or constant where it is, has a null r.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return _corr_by_pair_sums(df, columns)


def _pair_sums(columns: list[str], centres: np.ndarray):
    """Per-task reducer: for every pair, the sums over rows where both values are known."""
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def reduce_rows(batches):
        k = len(columns)
        total = {s: np.zeros((k, k)) for s in names}
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float) - centres
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            total["n"] += m.T @ m
            total["sx"] += x.T @ m
            total["sy"] += m.T @ x
            total["sxx"] += (x * x).T @ m
            total["syy"] += m.T @ (x * x)
            total["sxy"] += x.T @ x
        i, j = np.triu_indices(k, 1)
        yield pd.DataFrame({"i": i, "j": j, **{s: total[s][i, j] for s in names}})

    return reduce_rows


def _corr_by_pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.select(*(col(c).cast("double").alias(c) for c in columns))
    means = wide.agg(*(F.avg(F.when(finite(col(c)), col(c))) for c in columns)).first()
    centres = np.array([0.0 if m is None else m for m in means])
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = wide.mapInPandas(_pair_sums(columns, centres), schema).groupBy("i", "j").agg(
        *(F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    )
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    names = F.array(*map(F.lit, columns))
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
        F.when((vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("r"),
    )


def target_corr(df: DataFrame, target: str, features: list[str] | None = None, top: int | None = None) -> DataFrame:
    """|corr| of every numeric feature with the target, largest first."""
    features = features or [c for c in numeric_columns(df) if c != target]
    y = col(target).cast("double")
    ranked = _tall(df, features, {"abs_r": lambda c: F.abs(pair_corr(c.cast("double"), y))})
    if top is None:
        return ranked
    return ranked.orderBy(F.col("abs_r").desc_nulls_last(), F.col("feature")).limit(top)


# ---- families -------------------------------------------------------------

def family_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(family, feature) rows; a feature may be in several families."""
    rows = [(fam, c) for fam in FAMILIES for c in columns if in_family(c, fam)]
    return df.sparkSession.createDataFrame(rows, "family string, feature string")


def family_profile(df: DataFrame, columns: list[str], selected: list[str]) -> DataFrame:
    """Per family: features, selected features and mean missing percentage."""
    gaps = missing_report(df, columns)
    is_in = F.array_compact(F.array(*(
        F.when(F.col("feature").isin(*[c for c in columns if in_family(c, fam)] or [""]), F.lit(fam)) for fam in FAMILIES
    )))
    rows = gaps.withColumn("family", F.explode(is_in))
    return rows.groupBy("family").agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col("feature").isin(*selected) if selected else F.lit(False)).alias("n_selected"),
        F.avg("pct").alias("mean_missing_pct"),
    )


# ---- distributions --------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins with count and density; the last bin includes its right end."""
    v = col(column).cast("double")
    low, high, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint, density double")
    width = (high - low) / bins or 1.0 / bins
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.lit(n * width)).alias("density"),
    )


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Five-number summary per group."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    tall = grouped_quantiles(df, [group], column, list(names))
    return tall.groupBy(col(group)).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()))


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Published coefficients, highest power first, of the middle part (above, below) and of the tails.
NORMAL_COEFFICIENTS = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function (Acklam's rational approximation, |error| < 1.2e-9)."""
    a, b, c, d = NORMAL_COEFFICIENTS
    edge = 0.02425
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    mid, sq = p - 0.5, (p - 0.5) * (p - 0.5)
    return (
        F.when(p < edge, _poly(low, c) / _poly(low, d))
        .when(p > 1 - edge, -_poly(high, c) / _poly(high, d))
        .otherwise(_poly(sq, a) * mid / _poly(sq, b))
    )


QQ_RUN = 4096


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Ordered values against normal order-statistic medians; no global sort.

    Each distinct value knows how many rows come before it, so its rows get
    their places without ordering the whole column.
    """
    long = unpivot(df, [column])
    ranks = value_ranks(long, ["feature"], "x")
    first, last = F.col("before") + 1, F.col("before") + F.col("cnt")
    runs = ranks.select("n", F.col("x").alias("value"), last.alias("_last"), F.explode(F.sequence(first, last, F.lit(QQ_RUN))).alias("_from"))
    spread = runs.repartition("value", "_from")  # one row per run, so that a hot value's places are made in many tasks
    to = F.least(F.col("_from") + (QQ_RUN - 1), F.col("_last"))
    places = spread.select("n", "value", F.explode(F.sequence("_from", to)).alias("i"))
    end = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    share = F.when(F.col("i") == F.col("n"), end).when(F.col("i") == 1, 1 - end).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return places.select("i", "value", normal_quantile(share).alias("normal"))


def residuals(df: DataFrame, target: str, predictions: list[str], ids: list[str]) -> DataFrame:
    """Long table of fitted value and residual (predicted - actual) per model."""
    wide = df.select(*map(col, ids), col(target).cast("double").alias("actual"), *(col(p).cast("double").alias(p) for p in predictions))
    long = wide.unpivot([*map(col, ids), col("actual")], [col(p) for p in predictions], "model", "fitted")
    return long.select(*map(col, ids), "model", "actual", "fitted", (F.col("fitted") - F.col("actual")).alias("residual"))


def normal_reference(p: float) -> float:
    """Driver-side check value for :func:`normal_quantile`."""
    return NormalDist().inv_cdf(p)


# ---- cleanup --------------------------------------------------------------

def data_profile(df: DataFrame, target: str, group: str | None = None, ids: tuple[str, ...] = (), selected: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All tables of a look at the data before it is modelled, by name.

    missing, families (with the number of ``selected`` features), target, target_histogram, target_quantiles (against the
    normal), target_correlations; with a ``group`` also missing_by_group and target_by_group.
    """
    columns = [c for c in df.columns if c not in ids]
    features = [c for c in numeric_columns(df) if c not in (*ids, target)]
    tables = {
        "missing": missing_report(df, columns), "target": target_stats(df, target), "target_histogram": histogram(df, target),
        "target_quantiles": qq_points(df, target),
    }
    if features:
        tables["families"] = family_profile(df, features, list(selected))
        tables["target_correlations"] = target_corr(df, target, features)
    if group is not None and group in df.columns:
        tables["missing_by_group"] = missing_by_group(df, group, [c for c in columns if c != group])
        tables["target_by_group"] = box_stats(df, group, target)
    return tables


def missing_fractions(df: DataFrame) -> dict[str, float]:
    """Missing share per column: one pass, one row back."""
    row = df.agg(*(F.avg(col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    return {c: (row[i] or 0.0) for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.2, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share exceeds the threshold; ``keep`` columns stay."""
    kept = set(keep or [])
    shares = missing_fractions(df)
    dropped = [c for c in df.columns if shares[c] > threshold and c not in kept]
    return df.select(*(col(c) for c in df.columns if c not in dropped)), dropped


def drop_empty_std(df: DataFrame) -> DataFrame:
    """Drop deviation columns without any value."""
    names = [c for c in df.columns if c.endswith("__std")]
    if not names:
        return df
    row = df.agg(*(F.count(col(c)).alias(c) for c in names)).first()
    empty = {c for i, c in enumerate(names) if row[i] == 0}
    return df.select(*(col(c) for c in df.columns if c not in empty))


def column_manifest(master: DataFrame, stage_columns: dict[str, tuple[list[str], str]], keys: list[str]) -> DataFrame:
    """Each master column with its source, filled count and extremes (as text).

    ``stage_columns`` maps a source to its columns and the suffix its clashing
    columns took. A suffixed column belongs to the stage that owns the suffix.
    """
    def origin(name: str) -> str:
        if name in keys:
            return "key"
        plain = (s for s, (names, _) in stage_columns.items() if name in names)
        renamed = (
            s for s, (names, suffix) in stage_columns.items()
            if suffix and name.endswith(suffix) and name[: -len(suffix)] in names
        )
        return next(plain, None) or next(renamed, "unknown")

    table = _tall(master, master.columns, {
        "n_filled": F.count, "min": lambda c: F.min(c).cast("string"), "max": lambda c: F.max(c).cast("string"),
    }, name="column")
    sources = F.create_map(*(F.lit(v) for c in master.columns for v in (c, origin(c))))
    return table.select("column", sources[F.col("column")].alias("source"), "n_filled", "min", "max")


def report_rows(metrics: DataFrame, data: DataFrame, target: str, selected: int, dropped: int) -> DataFrame:
    """Tidy report: section, item, value. ``metrics`` is (model, metric, value)."""
    best = metrics.filter(F.col("metric") == "RMSE").agg(F.min_by("model", F.struct("value", "model")).alias("m"))
    shape = data.agg(F.count("*").cast("double").alias("rows"))
    stats = target_stats(data, target).select(F.explode(F.create_map(*(
        x for name in ("mean", "std", "skewness", "min", "max") for x in (F.lit(name), F.col(name))
    ))).alias("item", "value"))
    counts = [("columns", float(len(data.columns))), ("selected", float(selected)), ("dropped", float(dropped))]
    fixed = data.sparkSession.createDataFrame([("features", k, v) for k, v in counts], "section string, item string, value double")
    parts = [
        metrics.select(F.lit("model").alias("section"), F.concat_ws(" ", "model", "metric").alias("item"), "value"),
        best.select(F.lit("best_model").alias("section"), F.col("m").alias("item"), F.lit(None).cast("double").alias("value")),
        shape.select(F.lit("data").alias("section"), F.lit("rows").alias("item"), F.col("rows").alias("value")),
        stats.select(F.lit("target").alias("section"), "item", "value"),
        fixed,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mean_of(value: Column) -> Column:
    return STATS["mean"](value)
