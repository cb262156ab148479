"""Folds, model settings, out-of-fold prediction, importance and blending (MLlib)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.naming import col
from fieldlake.operators.linear import LineModel, fit_elastic_net, fit_fourier
from fieldlake.operators.metrics import regression_metrics
from fieldlake.session import at_once, cut_lineage, short_lived

FOLD = "fold"


# ---- folds ----------------------------------------------------------------

def kfold(df: DataFrame, row_id: str, k: int = 5, seed: int | None = 10000291) -> DataFrame:
    """Fold from the row id alone, so it does not change with partitioning. ``seed=None`` uses id modulo k."""
    fold = F.pmod(col(row_id), F.lit(k)) if seed is None else F.pmod(F.xxhash64(col(row_id), F.lit(seed)), F.lit(k))
    return df.withColumn(FOLD, fold.cast("int"))


def group_key(columns: list[str]) -> Column:
    return F.concat_ws("_", *(F.coalesce(col(c).cast("string"), F.lit("nan")) for c in columns))


def fold_runs(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """The greedy walk in closed form: (group size, first place, last place, folds).

    ``sizes`` is (group size, number of groups), largest size first. Groups of one size are interchangeable, so their
    folds follow from the loads: first the lighter folds fill up, one pick at a time, then the folds take turns. A run
    whose folds are fewer than its places repeats them in order.
    """
    load, out = [0] * k, []
    for size, count in sizes:
        place = 0
        while place < count and max(load) - min(load) >= size:
            i = min(range(k), key=lambda f: load[f])
            others = min((load[f] for f in range(k) if f != i), default=load[i])
            times = min(count - place, max(1, (others - load[i]) // size))
            out.append((size, place, place + times - 1, [i]))
            load[i] += times * size
            place += times
        if place < count:
            turns = sorted(range(k), key=lambda f: (load[f], f))
            out.append((size, place, count - 1, turns))
            for j, f in enumerate(turns):
                load[f] += size * ((count - place - j + k - 1) // k)
    return out


def group_kfold(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Whole groups to folds, largest group first to the lightest fold (ties: smaller key, lower fold).

    The walk needs only how many groups there are of each size. A group's place among those of its size comes from
    ranges of (size, key) and the counts of the ranges before it.
    """
    keyed = df.withColumn("_group", group_key(columns))
    sizes = keyed.groupBy("_group").agg(F.count("*").alias("n"))
    ranged = cut_lineage(sizes.repartitionByRange(F.desc("n"), F.asc("_group")).withColumn("_part", F.spark_partition_id()))
    per_part = ranged.groupBy("_part", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", "n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_part", "n").orderBy("_group"))
    placed = ranged.withColumn("_in", inside).join(offsets, ["_part", "n"]).select("_group", "n", (F.col("_in") - 1 + F.col("_off")).alias("_place"))
    # One row per size of group: at most about the square root of twice the row count.
    counts = [(r["n"], r["c"]) for r in ranged.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()]
    runs = df.sparkSession.createDataFrame(fold_runs(counts, k), "n bigint, _from bigint, _to bigint, _turns array<int>")
    hit = placed.join(runs, "n").filter(F.col("_place").between(F.col("_from"), F.col("_to")))
    fold = F.get("_turns", ((F.col("_place") - F.col("_from")) % F.size("_turns")).cast("int"))
    return keyed.join(hit.select("_group", fold.alias(FOLD)), "_group").drop("_group")


# ---- model settings -------------------------------------------------------

@dataclass
class ModelSpec:
    """How to fit one model: name, and a fit over a frame with 'features' and 'label'."""

    name: str
    build: Callable[[DataFrame, str], Transformer]

    def fit(self, train: DataFrame, row_id: str) -> Transformer:
        return self.build(train, row_id)


def _holdout(train: DataFrame, row_id: str, one_in: int = 5) -> DataFrame:
    return train.withColumn("_held", F.pmod(F.xxhash64(col(row_id), F.lit(17)), F.lit(one_in)) == 0)


def gbt_spec(max_iter: int = 5000, step: float = 0.02, depth: int = 6, min_rows: int = 40, seed: int = 10000291, tol: float = 1e-4) -> ModelSpec:
    """Boosted trees that stop once the held-out error no longer improves."""
    def build(train: DataFrame, row_id: str):
        booster = GBTRegressor(
            maxIter=max_iter, stepSize=step, maxDepth=depth, minInstancesPerNode=min_rows, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", validationIndicatorCol="_held", validationTol=tol, seed=seed,
        )
        return booster.fit(_holdout(train, row_id))

    return ModelSpec("boosted_trees", build)


def rf_spec(trees: int = 800, depth: int = 15, min_rows: int = 3, seed: int = 10000291) -> ModelSpec:
    def build(train: DataFrame, row_id: str):
        return RandomForestRegressor(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, featureSubsetStrategy="0.5", seed=seed
        ).fit(train)

    return ModelSpec("random_forest", build)


def kernel_regression_spec(
    components: int = 64, gammas: tuple[float, ...] = (0.05, 0.1), penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2), seed: int = 10000291
) -> ModelSpec:
    """Gaussian-kernel regression by random cosine features and a Huber line; grid chosen on an inner hold-out."""
    def build(train: DataFrame, row_id: str):
        return fit_fourier(_holdout(train, row_id), F.col("_held"), components, gammas, penalties, seed)

    return ModelSpec("kernel_regression", build)


# Fixed values of the method: shares of the absolute penalty; penalties from 1e-4 to 1e4, even in their logarithm.
RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
PENALTIES = tuple(np.logspace(-4, 4, 50))


def elastic_net_spec(ratios: tuple[float, ...] = RATIOS, penalties: tuple[float, ...] = PENALTIES, inner: int = 5) -> ModelSpec:
    """Elastic net whose mix and penalty are chosen by inner cross-validation over the whole path."""
    def build(train: DataFrame, row_id: str):
        inner_fold = F.pmod(F.xxhash64(col(row_id), F.lit(29)), F.lit(inner)).cast("int")
        return fit_elastic_net(train, inner_fold, inner, ratios, penalties)

    return ModelSpec("elastic_net", build)


def assemble(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)
    return out.withColumn("label", col(target).cast("double")) if target else out


# ---- fitting --------------------------------------------------------------

def oof_predict(
    df: DataFrame, specs: list[ModelSpec], features: list[str], target: str, row_id: str, k: int = 5, prepare=None, select=None, rows: int = 0
) -> DataFrame:
    """Out-of-fold prediction per model: row id, target, fold, one column per model.

    ``prepare(train, valid)`` fits the preparation on the training rows of each
    fold and returns both parts; ``select(train)`` picks that fold's features.
    Folds do not need each other and are worked on side by side unless there are many ``rows``. What a fold writes goes with it.
    """
    def predicted(fold: int) -> DataFrame:
        with short_lived(df.sparkSession):
            return scored_fold(fold)

    def scored_fold(fold: int) -> DataFrame:
        train, valid = df.filter(F.col(FOLD) != fold), df.filter(F.col(FOLD) == fold)
        if prepare is not None:
            train, valid = prepare(train, valid)
        chosen = select(train) if select is not None else features
        columns = lambda d: assemble(d.select(col(row_id), col(target), FOLD, *(col(c) for c in chosen)), chosen, target)
        ready = columns(train).select(col(row_id), "features", "label").persist()
        scored = columns(valid)
        for spec in specs:
            scored = spec.fit(ready, row_id).transform(scored).withColumnRenamed("prediction", spec.name)
        out = cut_lineage(scored.select(col(row_id), col(target), FOLD, *(s.name for s in specs)), outer=True)
        ready.unpersist()
        return out

    return reduce(DataFrame.unionByName, at_once(df.sparkSession, [partial(predicted, f) for f in range(k)], rows))


def fit_all(df: DataFrame, specs: list[ModelSpec], features: list[str], target: str, row_id: str) -> dict[str, Transformer]:
    ready = assemble(df.select(col(row_id), col(target), *map(col, features)), features, target).persist()
    models = {s.name: s.fit(ready, row_id) for s in specs}
    ready.unpersist()
    return models


def best_model(metrics: DataFrame) -> str:
    """Name with the smallest RMSE."""
    row = metrics.filter(F.col("metric") == "RMSE").agg(F.min_by("model", F.struct("value", "model"))).first()
    return row[0]


def fit_final(df: DataFrame, specs: list[ModelSpec], oof: DataFrame, features: list[str], target: str, row_id: str):
    """The best out-of-fold model, fitted again on all rows."""
    name = best_model(regression_metrics(oof, target, [s.name for s in specs]))
    spec = next(s for s in specs if s.name == name)
    return name, fit_all(df, [spec], features, target, row_id)[name]


def tree_importance(model: Model, features: list[str], spark) -> DataFrame:
    """Feature importance of a tree model, one row per feature."""
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


# ---- attribution ----------------------------------------------------------

def permuted(df: DataFrame, column: str, row_id: str, seed: int = 7, groups: int = 64) -> DataFrame:
    """The column shuffled: rows fall into random groups, and inside one each row takes the next row's value in random order.

    No global order is needed, and every value is used exactly once.
    """
    group = F.pmod(F.xxhash64(col(row_id), F.lit(seed)), F.lit(groups))
    order = Window.partitionBy(group).orderBy(F.xxhash64(col(row_id), F.lit(seed + 1)), col(row_id))
    ahead = F.lead(F.struct(col(column).alias("v"))).over(order)
    first = F.first(F.struct(col(column).alias("v"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(ahead, first)["v"])


def permutation_importance(
    df: DataFrame, model: Transformer, features: list[str], target: str, row_id: str, group_rows: int = 1000
) -> DataFrame:
    """Rise of the RMSE when one feature is shuffled: feature, importance.

    Rows are shuffled as by :func:`permuted`, in random groups of about ``group_rows`` rows. One shuffle brings each row the
    row whose values it takes; then the row and its copies, one per feature, are scored in one plan. A lone row of a group
    keeps its own value; a table without rows gives null importances.
    """
    ready = assemble(df, features, target).select(col(row_id), "label", vector_to_array("features").alias("_x"))
    groups = max(1, round(df.select(col(row_id)).count() / group_rows))
    group = F.pmod(F.xxhash64(col(row_id), F.lit(7)), F.lit(groups))
    order = Window.partitionBy(group).orderBy(F.xxhash64(col(row_id), F.lit(8)), col(row_id))
    first = F.first("_x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = ready.withColumn("_other", F.coalesce(F.lead("_x").over(order), first))
    copies = met.withColumn("_at", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    mixed = F.transform("_x", lambda x, i: F.when(i == F.col("_at"), F.get("_other", i)).otherwise(x))
    scored = model.transform(copies.select("_at", "label", array_to_vector(mixed).alias("features")))
    errors = scored.groupBy("_at").agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"))
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("_at"), F.lit(f).alias("feature")) for i, f in enumerate(["", *features], -1))))
    wanted = df.sparkSession.range(1).select(names.alias("_n")).select("_n.*").join(errors, "_at", "left")
    start = F.max(F.when(F.col("_at") == -1, F.col("rmse"))).over(Window.partitionBy(F.lit(1)))  # one row per feature
    return wanted.withColumn("importance", F.col("rmse") - start).filter("_at >= 0").select("feature", "importance")


def linear_shapley(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean |weight (x - mean)| per feature: the exact Shapley size of a linear model."""
    means = df.agg(*(F.avg(col(c).cast("double")).alias(c) for c in weights)).first()
    cells = [
        F.struct(F.lit(c).alias("feature"), F.avg(F.abs(F.lit(w) * (col(c).cast("double") - F.lit(means[i])))).alias("shapley")).alias(f"_{i}")
        for i, (c, w) in enumerate(weights.items())
    ]
    one = df.agg(*cells)
    return one.select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(weights))))).alias("_s")).select("_s.*")


def attribution(models: dict[str, Transformer], df: DataFrame, features: list[str], target: str, row_id: str) -> DataFrame:
    """model, feature, importance by shuffling, shapley (mean size; null unless the model is linear in the features)."""
    parts = []
    for name, model in models.items():
        one = permutation_importance(df, model, features, target, row_id)
        if isinstance(model, LineModel):
            one = one.join(linear_shapley(df, dict(zip(features, model.coefficients))), "feature", "left")
        else:
            one = one.withColumn("shapley", F.lit(None).cast("double"))
        parts.append(one.select(F.lit(name).alias("model"), "feature", "importance", "shapley"))
    return reduce(DataFrame.unionByName, parts)


# ---- blending -------------------------------------------------------------

def simplex(models: int, parts: int, floors: list[float]) -> list[tuple[float, ...]]:
    """All weights that are multiples of 1/parts above the floors and sum to 1."""
    free = 1.0 - sum(floors)
    cuts = itertools.combinations(range(parts + models - 1), models - 1)
    out = []
    for cut in cuts:
        edges = (-1, *cut, parts + models - 1)
        shares = [edges[i + 1] - edges[i] - 1 for i in range(models)]
        out.append(tuple(floors[i] + free * s / parts for i, s in enumerate(shares)))
    return out


def _offsets(oof: DataFrame, target: str, models: list[str]) -> DataFrame:
    """How far each model's prediction is off, as columns; rows without target or a prediction are left out."""
    y = col(target).cast("double")
    return oof.select(*((col(m).cast("double") - y).alias(f"_d{i}") for i, m in enumerate(models))).dropna()


def _task_sums(rows: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sums of ``size`` numbers made from batches of rows (a matrix): place, total, rows. One partial sum a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            total += work(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total), pa.array(np.full(size, n))], names=["place", "total", "n"])

    parts = rows.mapInArrow(run, "place int, total double, n bigint")
    return parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def blend_errors(oof: DataFrame, target: str, models: list[str], candidates: list[tuple[float, ...]]) -> DataFrame:
    """Mean absolute error of every candidate (weights that sum to 1): one pass, a matrix product a batch. Columns id, mae."""
    weights = np.array(candidates).T
    sums = _task_sums(_offsets(oof, target, models), len(candidates), lambda d: np.abs(d @ weights).sum(axis=0))
    return sums.select(F.col("place").alias("id"), F.try_divide("total", F.col("n").cast("double")).alias("mae"))


def blend_weights(
    oof: DataFrame, target: str, models: list[str], floors: dict[str, float] | None = None, parts: int = 10, refinements: int = 3
) -> dict[str, float]:
    """Weights >= floor, summing to 1, with the smallest mean absolute error.

    A coarse grid over the simplex, then ever finer grids round the winner. The
    error is convex in the weights, so the coarse winner is near the best.
    """
    least = [(floors or {}).get(m, 0.0) for m in models]
    tried = simplex(len(models), parts, least)
    step = (1.0 - sum(least)) / parts
    best: tuple[float, ...] = tried[0]
    for r in range(refinements + 1):
        if r:
            step /= 2
            moves = itertools.product((-2, -1, 0, 1, 2), repeat=len(models) - 1)
            near = []
            for move in moves:
                w = [best[i] + step * m for i, m in enumerate(move)]
                w.append(1.0 - sum(w))
                if all(w[i] >= least[i] - 1e-12 for i in range(len(models))):
                    near.append(tuple(w))
            tried = near
        winner = blend_errors(oof, target, models, tried).agg(F.min_by("id", F.struct("mae", "id"))).first()[0]
        best = tried[winner]
    return dict(zip(models, best))


def least_squares_on_simplex(gram: np.ndarray, floors: list[float]) -> np.ndarray:
    """w with the smallest w'Gw among w >= floors that sum to 1: every support is tried, so for a dozen models at most."""
    m, low = len(gram), np.array(floors)
    free, best, least = 1.0 - low.sum(), None, np.inf
    for size in range(1, m + 1):
        for support in itertools.combinations(range(m), size):
            s = list(support)
            system = np.zeros((size + 1, size + 1))
            system[:size, :size], system[:size, size], system[size, :size] = 2 * gram[np.ix_(s, s)], 1.0, 1.0
            right = np.append(-2 * gram[s] @ low, free)
            part = np.linalg.lstsq(system, right, rcond=None)[0][:size]
            if (part < -1e-12).any() or abs(part.sum() - free) > 1e-9:
                continue
            w = low.copy()
            w[s] += np.maximum(part, 0.0)
            value = float(w @ gram @ w)
            if value < least:
                best, least = w, value
    return best


def convex_blend(
    oof: DataFrame, target: str, models: list[str], floors: dict[str, float] | None = None, tolerance: float = 1e-7
) -> dict[str, float]:
    """Weights >= floor, summing to 1, with the smallest mean absolute error, which is convex in them.

    Each step bounds the absolute errors from above by parabolas that touch them at the present weights, and goes to the
    lowest point of their sum. A step is one aggregate: the exact error and the moments of the parabolas, a handful of
    numbers whatever the rows. Parabolas grow sharper until three steps in turn lower the error no more. Rows without
    target or a prediction are left out; without rows the free weight is shared evenly.
    """
    if len(models) > 12:
        raise ValueError("at most a dozen models can be blended")
    least = [(floors or {}).get(m, 0.0) for m in models]
    with short_lived(oof.sparkSession):
        return _lowest(cut_lineage(_offsets(oof, target, models)), models, least, tolerance)


def _lowest(rows: DataFrame, models: list[str], least: list[float], tolerance: float) -> dict[str, float]:
    m = len(models)

    def sums(w: np.ndarray, width: float) -> tuple[float | None, np.ndarray]:
        def work(d: np.ndarray) -> np.ndarray:
            r = np.abs(d @ w)
            return np.append(r.sum(), (d / np.maximum(r, width)[:, None]).T @ d)

        found = _task_sums(rows, 1 + m * m, work).collect()
        out, n = np.zeros(1 + m * m), 0
        for r in found:
            out[r["place"]], n = r["total"], r["n"]
        return (float(out[0]) / n if n else None), out[1:].reshape(m, m) / max(n, 1)

    w = np.array(least) + (1.0 - sum(least)) / len(models)
    loss, _ = sums(w, 1.0)
    best, lowest, idle, width = w, loss, 0, (loss or 0.0) / 10
    while loss and idle < 3:
        loss, gram = sums(w, max(width, 1e-300))
        if loss < lowest * (1 - tolerance):
            idle = 0
        elif width <= 1e-4 * lowest:
            idle += 1
        if loss < lowest:
            best, lowest = w, loss
        w, width = least_squares_on_simplex(gram, least), max(width / 4, 1e-6 * lowest)
    return dict(zip(models, map(float, best)))


def blended(df: DataFrame, weights: dict[str, float], name: str = "ensemble") -> DataFrame:
    return df.withColumn(name, sum((col(m) * F.lit(float(w)) for m, w in weights.items()), F.lit(0.0)))


def champion(oof: DataFrame, target: str, weights: dict[str, float]) -> DataFrame:
    """Metrics of the models and the blend, with the blend kept only when its RMSE is smallest."""
    table = regression_metrics(blended(oof, weights), target, [*weights, "ensemble"])
    whole = Window.partitionBy(F.lit(1))  # four rows per model
    rmse = F.when(F.col("metric") == "RMSE", F.struct("value", (F.col("model") == "ensemble").alias("e"), "model"))
    return table.withColumn("is_best", F.col("model") == F.min(rmse).over(whole)["model"])

