"""Preparation steps as fit (parameter table) and apply (projection).

Fits are Spark aggregates giving one row per feature or level. Applying turns
the table into literals of a projection: no join, no shuffle, any row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.config import TERRAIN_NAMES, ModelConfig, in_family
from fieldlake.functions.features import doy_sin
from fieldlake.naming import col
from fieldlake.operators.impute import iterative_impute_apply, iterative_impute_fit
from fieldlake.operators.neighbours import donor_chunks, knn_impute
from fieldlake.operators.order import column_quantiles
from fieldlake.operators.profile import numeric_columns
from fieldlake.session import cut_lineage, short_lived

KNN = 5  # neighbours that fill a gap of a vegetation column


def _replace(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """One projection that swaps columns in place."""
    return df.select(*(made[c].alias(c) if c in made else col(c) for c in df.columns))


def _params(state: DataFrame, *names: str) -> dict[str, tuple]:
    """Parameter table (one row per feature) as a dict."""
    return {r["feature"]: tuple(r[n] for n in names) for r in state.select("feature", *names).collect()}


def prepare_model_input(df: DataFrame, cfg: ModelConfig = ModelConfig(), ids: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Date to its yearly sine, single-precision numbers, columns without use dropped. Ids keep their type and value."""
    gone = {"date", *cfg.extra_drops}
    if "ET__mean" in df.columns and "ET" in df.columns:
        gone.add("ET__mean")
    numbers = set(numeric_columns(df)) - set(ids)
    kept = [c for c in df.columns if c not in gone]
    columns = [col(c).cast("float").alias(c) if c in numbers else col(c) for c in kept]
    if "date" in df.columns:
        columns.append(doy_sin(col("date")).cast("float").alias("doy_sin"))
    return df.select(*columns)


# ---- winsorise ------------------------------------------------------------

def winsor_fit(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Exact low/high percentile per column: feature, low, high."""
    tall = column_quantiles(df, columns, [low, high])
    return tall.groupBy("feature").agg(
        F.max(F.when(F.col("p") == low, F.col("value"))).alias("low"),
        F.max(F.when(F.col("p") == high, F.col("value"))).alias("high"),
    )


def winsor_apply(df: DataFrame, state: DataFrame) -> DataFrame:
    """Clip to the fitted limits; nulls stay null."""
    made = {}
    for name, (low, high) in _params(state, "low", "high").items():
        if name in df.columns:
            c = col(name).cast("double")
            made[name] = F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
    return _replace(df, made)


# ---- median imputation ----------------------------------------------------

def median_impute_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per column: feature, median."""
    return column_quantiles(df, columns, [0.5]).select("feature", F.col("value").alias("median"))


def median_impute_apply(df: DataFrame, state: DataFrame) -> DataFrame:
    known = _params(state, "median")
    return _replace(df, {c: F.coalesce(col(c).cast("double"), F.lit(known[c][0])) for c in df.columns if c in known})


def gap_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that still have nulls: one pass."""
    if not columns:
        return []
    row = df.agg(*(F.bool_or(col(c).isNull()).alias(c) for c in columns)).first()
    return [c for i, c in enumerate(columns) if row[i]]


def fallback_impute_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Medians of whatever columns still have gaps."""
    left = gap_columns(df, columns)
    if left:
        return median_impute_fit(df, left)
    return df.sparkSession.createDataFrame([], "feature string, median double")


# ---- categories -----------------------------------------------------------

def _level(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit("__nan__"))


def _numbered(levels: DataFrame) -> DataFrame:
    """feature, level and its code, the place from 0 among the feature's sorted levels.

    Levels are numbered inside ranges of (feature, level), to which the counts of the ranges before are added, so the
    levels of a column lie in as many tasks as they need.
    """
    ranged = cut_lineage(levels.select("feature", "level").repartitionByRange("feature", "level").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("feature", "_part").agg(F.count("*").alias("_c"))  # one row a feature and range
    offsets = counts.select("feature", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("feature", "_part").orderBy("level")) - 1
    return ranged.withColumn("_in", inside).join(offsets, ["feature", "_part"]).select("feature", "level", (F.col("_in") + F.col("_off")).cast("int").alias("code"))


def _levels(df: DataFrame, columns: list[str], nulls: bool = True) -> DataFrame:
    """Distinct levels of each column: feature, level."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, level string")
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), (_level(c) if nulls else col(c).cast("string")).alias("level")) for c in columns
    ))).alias("_s")
    return df.select(pairs).select("_s.*").filter(F.col("level").isNotNull()).distinct()


def level_table(df: DataFrame, columns: list[str], nulls: bool = True) -> DataFrame:
    """Sorted levels of each column: feature, level, code (0-based)."""
    return _numbered(_levels(df, columns, nulls))


def label_encode_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    return level_table(df, columns)


def label_encode_apply(df: DataFrame, state: DataFrame, columns: list[str], suffix: str = "__code") -> DataFrame:
    """Add integer codes. Levels not seen in the fit are numbered after the known ones, in sorted order.

    The codes are written once and joined, one column after the other; Spark knows their size and broadcasts them if small.
    """
    size = state.groupBy("feature").agg(F.count("*").alias("_n"))
    fresh = _numbered(_levels(df, columns).join(state, ["feature", "level"], "left_anti")).join(size, "feature", "left")
    codes = cut_lineage(state.select("feature", "level", F.col("code").cast("int").alias("code")).unionByName(
        fresh.select("feature", "level", (F.coalesce("_n", F.lit(0)) + F.col("code")).cast("int").alias("code"))))
    out = df
    for c in columns:
        one = codes.filter(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("code").alias(c + suffix))
        out = out.withColumn("_level", _level(c)).join(one, "_level", "left").drop("_level")
    return out


def one_hot_fit(df: DataFrame, columns: list[str], max_levels: int = 1000, buckets: int = 256) -> DataFrame:
    """The indicator columns: feature, level, code, name. All sorted levels of a column but the first get one.

    A column of more than ``max_levels`` levels gets ``buckets`` indicators of hashed levels instead, which hold no level
    and are named ``<prefix>_hash_<bucket>``: the frame stays as wide as it may be, whatever the levels.
    """
    columns = [c for c in columns if c in df.columns]
    levels = cut_lineage(_levels(df, columns, nulls=False))
    many = {r["feature"] for r in levels.groupBy("feature").count().filter(F.col("count") > max_levels).collect()}  # of the columns named
    prefix = F.element_at(F.split("feature", r"\("), 1)
    few = _numbered(levels.filter(~F.col("feature").isin(*many)) if many else levels)
    state = few.filter("code > 0").withColumn("name", F.concat_ws("_", prefix, F.col("level")))
    if not many:
        return state
    hashed = df.sparkSession.createDataFrame([(c,) for c in sorted(many)], "feature string").select(
        "feature", F.lit(None).cast("string").alias("level"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("code"))
    return state.unionByName(hashed.withColumn("name", F.concat_ws("_hash_", prefix, F.col("code").cast("string"))))


def one_hot_apply(df: DataFrame, state: DataFrame) -> DataFrame:
    """Replace category columns by the fitted indicators: unseen levels give all zeros, absent columns zeros.

    Where a column is hashed, unseen levels fall into a bucket, too; nulls give all zeros.
    """
    rows = state.orderBy("feature", "code").collect()  # as many as one_hot_fit allows
    used = {r["feature"] for r in rows}
    base = [col(c) for c in df.columns if c not in used]
    buckets = {f: sum(r["feature"] == f for r in rows) for f in {r["feature"] for r in rows if r["level"] is None}}

    def indicator(row) -> Column:
        if row["feature"] not in df.columns:
            return F.lit(0)
        level = col(row["feature"]).cast("string")
        if row["level"] is not None:
            return F.coalesce(level == row["level"], F.lit(False)).cast("int")
        return (level.isNotNull() & (F.pmod(F.xxhash64(level), F.lit(buckets[row["feature"]])) == row["code"])).cast("int")

    return df.select(*base, *(indicator(r).alias(r["name"]) for r in rows))


# ---- scaling --------------------------------------------------------------

def robust_scale_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median, scale: the scale is the interquartile range, or 1 when that is 0."""
    tall = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    wide = tall.groupBy("feature").agg(at(0.25).alias("_a"), at(0.5).alias("median"), at(0.75).alias("_b"))
    spread = F.col("_b") - F.col("_a")
    return wide.select("feature", "median", F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"))


def robust_scale_apply(df: DataFrame, state: DataFrame) -> DataFrame:
    """(x - median) / scale; a fitted column that is absent is first filled with its median."""
    known = _params(state, "median", "scale")
    made = {c: (col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in known.items() if c in df.columns}
    absent = {c: F.lit(0.0) for c in known if c not in df.columns}
    out = _replace(df, made)
    return out.withColumns(absent) if absent else out


def assert_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error naming the worst 25 columns with nulls."""
    if columns:
        row = df.agg(*(F.avg(col(c).isNull().cast("double")).alias(c) for c in columns)).first()
        bad = sorted(((row[i], c) for i, c in enumerate(columns) if row[i]), key=lambda b: (-b[0], b[1]))[:25]
        if bad:
            raise ValueError("nulls remain in: " + ", ".join(f"{c} ({share:.2%})" for share, c in bad))
    return df


# ---- whole preprocessor ---------------------------------------------------

class Preprocessor:
    """All steps in order, fitted on training rows and replayed on any rows.

    winsorise, iterative (weather), neighbours or median (vegetation), median
    (soil, terrain), median (what is left), one-hot, robust scaling.
    """

    def __init__(self, cfg: ModelConfig = ModelConfig(), row_id: str = "row_id"):
        self.cfg, self.row_id = cfg, row_id
        self.state: dict[str, DataFrame] = {}
        self.donors: DataFrame | None = None
        self.chunks: DataFrame | None = None  # of the donors, made when a gap is first searched
        self.columns: list[str] = []

    def _numeric(self, df: DataFrame) -> list[str]:
        return [c for c in numeric_columns(df) if c not in (self.cfg.target, self.row_id)]

    def fit(self, df: DataFrame) -> Preprocessor:
        self._run(df, fitting=True)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._run(df, fitting=False)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self._run(df, fitting=True)

    def _fitted(self, name: str, fitting: bool, make) -> DataFrame | None:
        """Fit once; the small parameter table is cut from its source, so replays never refit."""
        if fitting:
            self.state[name] = cut_lineage(make(), outer=True)
        return self.state.get(name)

    def _run(self, df: DataFrame, fitting: bool) -> DataFrame:
        if fitting:
            self.columns = df.columns
        df = df.select(*(col(c) for c in df.columns if c in self.columns))
        numeric = self._numeric(df)
        categories = [c for c in self.cfg.category_columns if c in df.columns]
        out = winsor_apply(df, self._fitted("winsor", fitting, lambda: winsor_fit(df, numeric)))

        weather = [c for c in numeric if in_family(c, "Meteorology")]
        if weather:
            fitted = self._fitted("weather", fitting, lambda: iterative_impute_fit(out, weather))
            out = iterative_impute_apply(out, fitted, weather)

        plants = [c for c in numeric if in_family(c, "Vegetation")]
        plant_gaps = gap_columns(out, plants)
        if plants and categories:
            codes = self._fitted("labels", fitting, lambda: label_encode_fit(out, categories))
            coded = label_encode_apply(out, codes, categories)
            context = [f"{c}__code" for c in categories]
            if fitting:
                self.donors = cut_lineage(coded.select(col(self.row_id), *map(col, [*plants, *context])), outer=True)
                self.state["donors"], self.chunks = self.donors, None
            if plant_gaps:  # read several times by the search and by the steps after it
                donors = self.state["donors"]
                if self.chunks is None:
                    self.chunks = donor_chunks(donors, self.row_id, [], [*plants, *context], KNN)
                with short_lived(df.sparkSession):
                    coded = cut_lineage(knn_impute(cut_lineage(coded), plants, context, self.row_id, k=KNN, donors=donors, chunks=self.chunks), outer=True)
            out = coded.drop(*context)
        elif plants:
            out = median_impute_apply(out, self._fitted("plants", fitting, lambda: median_impute_fit(out, plants)))

        ground = [c for c in numeric if in_family(c, "Soil") or any(t in c.lower() for t in TERRAIN_NAMES)]
        if ground:
            out = median_impute_apply(out, self._fitted("ground", fitting, lambda: median_impute_fit(out, ground)))
        out = median_impute_apply(out, self._fitted("fallback", fitting, lambda: fallback_impute_fit(out, numeric)))
        if categories:
            out = one_hot_apply(out, self._fitted("one_hot", fitting, lambda: one_hot_fit(out, categories)))
        scaled = self._numeric(out)
        out = robust_scale_apply(out, self._fitted("scale", fitting, lambda: robust_scale_fit(out, scaled)))
        return assert_no_nulls(out, self._numeric(out))

