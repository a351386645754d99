"""Fitting, tuning and comparing pace models with pyspark.ml."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge import schema
from paceforge.operators import boosting, encoding, forest, imputation, scoring
from paceforge.schema import q
from paceforge.session import stage

# --- fixed values: default boosting parameters ---
DEFAULT_PARAMS: dict[str, object] = {
    "maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 1, "minInfoGain": 0.0, "seed": 42,
}

# --- fixed value: rounds without a lower validation error after which boosting stops ---
PATIENCE = 50

# --- fixed values: rows that a task of a large fit holds at most, and up to how many rows a fit is small ---
TASK_ROWS = 500_000
SMALL_ROWS = 100_000

# --- fixed values: search ranges (low, high); learning rate is drawn on a log scale ---
SEARCH_SPACE = {
    "maxDepth": (3, 10), "stepSize": (0.01, 0.2), "minInstancesPerNode": (1, 10),
    "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.6, 1.0), "minInfoGain": (0.0, 5.0),
}

# --- fixed values: full grid of the exhaustive search ---
FULL_GRID: dict[str, list] = {
    "maxDepth": [3, 5, 7],
    "stepSize": [0.01, 0.05, 0.1],
    "maxIter": [100, 500, 1000],
    "minInstancesPerNode": [1, 3, 5],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    "minInfoGain": [0.0, 0.1, 0.2],
}

# --- fixed values: the two configurations compared by default ---
NAMED_CONFIGS: dict[str, dict[str, object]] = {
    "wide": {"stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 1, "subsamplingRate": 0.8, "maxIter": 500},
    "deep": {"stepSize": 0.01, "maxDepth": 7, "minInstancesPerNode": 3, "subsamplingRate": 0.7, "maxIter": 1000},
}


def prepare(
    rows: DataFrame,
    feature_set: str | Sequence[str] = "no_pace_no_time",
    key: str = "activity_id",
    target: str = schema.TARGET,
    keep: Sequence[str] = (),
    categorical: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Key, kept columns, label, numeric features and split of the rows that have a target.

    Columns named in ``categorical`` are filled with their mode and become sparse 0/1 vectors, both fitted on
    the training rows; they come behind the numeric features.
    """
    if isinstance(feature_set, str):
        numeric = schema.numeric_columns(rows)
        features = schema.select_features(numeric, **schema.FEATURE_SETS[feature_set])
    else:
        features = list(feature_set)
    df = rows.filter(F.col(target).isNotNull()).select(
        key, *keep, F.col(target).alias("label"), *[F.col(q(c)).cast("double").alias(c) for c in features], *map(q, categorical)
    )
    df = encoding.hash_split(df, key)
    if categorical:
        train = df.filter("split = 'train'")
        modes = imputation.fit_modes(train, categorical)
        fitted = [encoding.fit_categories(imputation.fill(train, modes), c) for c in categorical]
        df = encoding.one_hot_sparse(imputation.fill(df, modes), fitted)
        features = [*features, *[f"{c}__vector" for c in categorical]]
    return df, features


def _regressor(params: Mapping[str, object]) -> GBTRegressor:
    merged = {**DEFAULT_PARAMS, **params}
    return GBTRegressor(labelCol="label", featuresCol="features", **merged)


def fit_inputs(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Mean imputation and assembly, fitted on training rows only; vector columns are taken as they are."""
    vectors = [c for c in features if isinstance(train.schema[c].dataType, VectorUDT)]
    numeric = [c for c in features if c not in vectors]
    filled = [f"{c}__filled" for c in numeric]
    imputer = Imputer(strategy="mean", inputCols=numeric, outputCols=filled)
    return Pipeline(stages=[imputer, VectorAssembler(inputCols=[*filled, *vectors], outputCol="features")]).fit(train)


_MODEL_ROWS = ("label", "features", "split")


def model_rows(prepared: DataFrame, inputs: PipelineModel, *keep: str) -> DataFrame:
    """Filled rows, written once as a search reads them many times, and assembled where they are read: vectors
    take several times as long to write as their numbers in columns."""
    imputer, assembler = inputs.stages
    filled = imputer.transform(prepared).select(*keep, "label", *map(q, assembler.getInputCols()), "split")
    return assembler.transform(stage(filled, "model-rows")).select(*keep, *_MODEL_ROWS)


def error_curve(trees: GBTRegressionModel, rows: DataFrame) -> list[float]:
    """Validation MAE after every round, from one pass over the validation rows; none without such rows."""
    errors = forest.round_errors(trees, rows.filter("split = 'validation'")).select("round", "mae")
    return [r["mae"] for r in errors.orderBy("round").collect()]  # as many rows as rounds


def _fit(params: Mapping[str, object], rows: DataFrame) -> GBTRegressionModel:
    """Subsampling follows the places of the rows, so they are put in an order of their own first; the model
    then doesn't depend on how the table was written or read.

    Hundreds of passes run over the pieces of a large table, and one piece more than there are cores makes each
    of them a task longer; so it is dealt out in equal rounds of all cores, and kept in that order while the fit
    asks for it several times before the first tree. Small tables are left to Spark's merging of pieces.
    """
    place = F.xxhash64("label", vector_to_array("features"))
    placed = rows.select("label", "features", place.alias("place"))
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    if count <= SMALL_ROWS:
        return _regressor(params).fit(placed.repartition("place").sortWithinPartitions("place"))
    pieces = cores * math.ceil(count / (cores * TASK_ROWS))
    ordered = placed.repartition(pieces, "place").sortWithinPartitions("place").persist()
    try:
        return _regressor(params).fit(ordered)
    finally:
        ordered.unpersist()


def fit_trees(
    rows: DataFrame, params: Mapping[str, object] | None = None, early_stopping: bool = True, patience: int = PATIENCE
) -> GBTRegressionModel:
    """Boosted trees on :func:`model_rows`.

    With early stopping the trees are fitted on the training rows and the ensemble is cut to the round of
    the lowest validation MAE before ``patience`` rounds in a row brought no lower one. Without it they are
    fitted on training and validation rows for the full number of rounds.
    """
    if not early_stopping:
        return _fit(params or {}, encoding.union_parts(rows, "train", "validation"))
    trees = _fit(params or {}, rows.filter("split = 'train'"))
    curve = error_curve(trees, rows)
    return forest.first_rounds(trees, forest.best_round(curve, patience)) if curve else trees


def fit_model(
    prepared: DataFrame,
    features: Sequence[str],
    params: Mapping[str, object] | None = None,
    early_stopping: bool = True,
    patience: int = PATIENCE,
) -> PipelineModel:
    """Imputation, assembly and :func:`fit_trees` as one model."""
    inputs = fit_inputs(prepared.filter("split = 'train'"), features)
    rows = model_rows(encoding.union_parts(prepared, "train", "validation"), inputs)
    trees = fit_trees(rows, params, early_stopping, patience)
    return PipelineModel(stages=[*inputs.stages, trees])


def round_curve(prepared: DataFrame, features: Sequence[str], params: Mapping[str, object] | None = None, patience: int = PATIENCE) -> DataFrame:
    """Validation error after every round of one fit, and which round is kept: round, n, mae, rmse, chosen."""
    inputs = fit_inputs(prepared.filter("split = 'train'"), features)
    rows = model_rows(encoding.union_parts(prepared, "train", "validation"), inputs)
    trees = _fit(params or {}, rows.filter("split = 'train'"))
    errors = stage(forest.round_errors(trees, rows.filter("split = 'validation'")), "round-errors")
    curve = [r["mae"] for r in errors.orderBy("round").collect()]
    kept = forest.best_round(curve, patience) if curve else 0
    return errors.withColumn("chosen", F.col("round") == kept)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


def evaluate(model: PipelineModel, prepared: DataFrame, split: str = "test") -> dict[str, float]:
    scored = model.transform(prepared.filter(F.col("split") == split))
    row = scoring.regression_metrics(scored).first()
    return {m: row[m] for m in ("mae", "rmse", "r2")}


def draw_params(trials: int, seed: int = 42, **fixed: object) -> list[dict[str, object]]:
    """Seeded random draws from the search space."""
    rng = random.Random(seed)
    drawn = []
    for _ in range(trials):
        low, high = SEARCH_SPACE["stepSize"]
        params: dict[str, object] = {
            "maxDepth": rng.randint(*SEARCH_SPACE["maxDepth"]),
            "stepSize": math.exp(rng.uniform(math.log(low), math.log(high))),
            "minInstancesPerNode": rng.randint(*SEARCH_SPACE["minInstancesPerNode"]),
            "subsamplingRate": rng.uniform(*SEARCH_SPACE["subsamplingRate"]),
            "featureSubsetStrategy": f"{rng.uniform(*SEARCH_SPACE['featureSubsetStrategy']):.4f}",
            "minInfoGain": rng.uniform(*SEARCH_SPACE["minInfoGain"]),
        }
        drawn.append({**params, **fixed})
    return drawn


_TRIALS = "config string, params map<string,string>, mae double, rmse double, r2 double"
_FOLDS = "params map<string,string>, fold int, mae double"


class FinishedRuns:
    """Results of finished fits under ``folder``, one small table per key, written when the fit is done.

    A search that is started again finds them and fits only what is missing. The key covers parameters,
    features and whatever else the caller names, such as the data's version; without a folder nothing is kept.
    """

    def __init__(self, spark, folder: str | None, schema: str, *context: object):
        self.spark, self.folder, self.schema, self.context = spark, folder, schema, context
        self.found: dict[str, list] = {}
        if folder is not None:
            try:
                table = spark.read.schema(f"{schema}, run string").parquet(folder)
                for row in table.collect():  # as many rows as finished runs
                    self.found.setdefault(row["run"], []).append(tuple(row)[:-1])
            except AnalysisException as missing:
                if "PATH_NOT_FOUND" not in str(missing):
                    raise

    def get(self, what: object, fit: Callable[[], list]) -> list:
        text = json.dumps([self.context, what], sort_keys=True, default=str)
        run = hashlib.sha256(text.encode()).hexdigest()[:32]
        if run in self.found:
            return self.found[run]
        rows = fit()
        if self.folder is not None:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        return rows


def compare(
    prepared: DataFrame,
    features: Sequence[str],
    configs: Mapping[str, Mapping[str, object]],
    split: str = "validation",
    parallelism: int = 2,
    patience: int = PATIENCE,
    runs: str | None = None,
    data: str = "",
) -> DataFrame:
    """Fit every named configuration and return the runs table with its metrics on ``split``.

    The fits are Spark jobs submitted side by side over rows that are filled, assembled and written once;
    only their metrics come back. ``runs`` is a folder for finished runs of the data named ``data``.
    """
    spark = prepared.sparkSession
    rows = model_rows(prepared, fit_inputs(prepared.filter("split = 'train'"), features))
    finished = FinishedRuns(spark, runs, _TRIALS, "compare", list(features), split, patience, data)

    def one(item: tuple[str, Mapping[str, object]]) -> list:
        name, params = item

        def fit() -> list:
            trees = fit_trees(rows, params, patience=patience)
            m = scoring.regression_metrics(trees.transform(rows.filter(F.col("split") == split))).first()
            return [(name, {k: str(v) for k, v in params.items()}, m["mae"], m["rmse"], m["r2"])]

        return finished.get([name, dict(params)], fit)

    with ThreadPoolExecutor(parallelism) as pool:
        table = [row for rows_of in pool.map(one, configs.items()) for row in rows_of]
    return spark.createDataFrame(table, _TRIALS)


def compare_named(prepared: DataFrame, features: Sequence[str], names: Sequence[str] = tuple(NAMED_CONFIGS), **options) -> DataFrame:
    """The runs table of the default configurations on the test rows; :func:`scoring.best_run` picks one."""
    return compare(prepared, features, {n: NAMED_CONFIGS[n] for n in names}, "test", **options)


def random_search(
    prepared: DataFrame, features: Sequence[str], trials: int = 50, seed: int = 42, parallelism: int = 2, runs: str | None = None, data: str = "", **fixed: object
) -> DataFrame:
    """Trial table of a seeded random search; the best trial has the lowest validation MAE."""
    configs = {f"trial_{i:03d}": p for i, p in enumerate(draw_params(trials, seed, **fixed))}
    return compare(prepared, features, configs, "validation", parallelism, runs=runs, data=data)


class _TaskFits:
    """Fits of a search over a small table, each in one task; :meth:`of` gives none where Spark's jobs are needed."""

    def __init__(self, rows: DataFrame, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.spark, self.x, self.y, self.fold, self.binned = rows.sparkSession, x, y, fold, {}

    @staticmethod
    def of(rows: DataFrame, features: Sequence[str], prepared: DataFrame, points: Sequence[Mapping[str, object]]) -> _TaskFits | None:
        if rows.count() > boosting.MOST_ROWS or any(isinstance(prepared.schema[c].dataType, VectorUDT) for c in features):
            return None
        values = vector_to_array("features")
        placed = rows.filter("fold IS NOT NULL").select("label", "fold", values.alias("x"), F.xxhash64("label", values).alias("place"))
        table = placed.orderBy("place").collect()  # at most MOST_ROWS
        if not table:
            return None
        x, y = np.array([r["x"] for r in table], float), np.array([r["label"] for r in table], float)
        if not all(boosting.covers({**DEFAULT_PARAMS, **p}, x.shape[1]) for p in points) or not (np.isfinite(x).all() and np.isfinite(y).all()):
            return None
        return _TaskFits(rows, x, y, np.array([r["fold"] for r in table], int))

    def fitted(self, held: int) -> int:
        return int((self.fold != held).sum())

    def errors(self, held: int, rounds: Sequence[int], points: Sequence[Mapping[str, object]]) -> list[dict[int, float]]:
        """Errors after each of ``rounds`` of the points, which differ in the lowest gain of a split alone."""
        fits = [_regressor(p) for p in points]
        names = sorted(boosting.KNOWN)
        params, gains = {n: fits[0].getOrDefault(n) for n in names}, [f.getMinInfoGain() for f in fits]
        key = (held, params["maxBins"])
        if key not in self.binned:
            self.binned[key] = self.spark.sparkContext.broadcast(boosting.Binned.of(self.x, self.y, self.fold == held, params["maxBins"]))
        shared = self.binned[key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                found = boosting.fold_errors(shared.value, rounds, params, gains)
                cells = [(i, k, mae) for i, maes in enumerate(found) for k, mae in maes.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("point", "round", "mae"), c)) for c in cells], pa.schema([("point", pa.int32()), ("round", pa.int32()), ("mae", pa.float64())]))

        out: list[dict[int, float]] = [{} for _ in points]
        for r in self.spark.range(0, 1, 1, 1).mapInArrow(run, "point int, round int, mae double").collect():
            out[r["point"]][r["round"]] = r["mae"]
        return out


def cross_validate(
    prepared: DataFrame,
    features: Sequence[str],
    grid: Mapping[str, Sequence],
    folds: int = 3,
    parallelism: int = 2,
    limit: int | None = None,
    key: str = "activity_id",
    runs: str | None = None,
    data: str = "",
    **fixed: object,
) -> DataFrame:
    """Mean fold MAE of every grid point over train and validation rows.

    Points that differ in ``maxIter`` alone share a fit: the first rounds of the longest are the shorter ones,
    and all their errors come from one pass over the held-out fold. Over small tables each fit is one task, as
    many side by side as there are cores, and over others ``parallelism`` fits run as Spark's jobs. Folds follow the hash of ``key``, so they
    do not change with the partitioning. Fill values are means of the training rows, also in folds that hold
    validation rows. With a ``limit``, larger grids are refused rather than cut. ``runs`` is a folder for
    finished fits of the data named ``data``; a search started again continues there.
    """
    size = math.prod(len(v) for v in grid.values())
    if limit is not None and size > limit:
        raise ValueError(f"grid has {size} points, limit is {limit}")
    spark = prepared.sparkSession
    inputs = fit_inputs(prepared.filter("split = 'train'"), features)
    fold = F.pmod(encoding.split_bucket(key), F.lit(folds)).cast("int")
    parts = encoding.union_parts(prepared, "train", "validation").withColumn("fold", fold)
    ready = model_rows(parts, inputs, "fold")
    rounds = sorted(int(r) for r in grid.get("maxIter", [fixed.get("maxIter", DEFAULT_PARAMS["maxIter"])]))
    others = {k: list(v) for k, v in grid.items() if k != "maxIter"}
    shared = [dict(zip(others, values)) for values in itertools.product(*others.values())]
    finished = FinishedRuns(spark, runs, _FOLDS, "folds", list(features), folds, key, rounds, dict(fixed), data)

    fits = [{**fixed, **point, "maxIter": rounds[-1]} for point in shared]
    tasks = _TaskFits.of(ready, features, prepared, fits)

    def one(item: tuple[list[dict], int]) -> list:
        points, held = item
        texts = [{k: str(v) for k, v in point.items()} for point in points]
        curves: list[dict[int, float]] = []

        def errors(i: int) -> dict[int, float]:
            if tasks is not None and tasks.fitted(held):
                if not curves:
                    curves.extend(tasks.errors(held, rounds, [{**fixed, **p, "maxIter": rounds[-1]} for p in points]))
                return curves[i]
            trees = _fit({**fixed, **points[i], "maxIter": rounds[-1]}, ready.filter(F.col("fold") != held))
            found = forest.round_errors(trees, ready.filter(F.col("fold") == held))
            return {r["round"]: r["mae"] for r in found.filter(F.col("round").isin(rounds)).collect()}

        def fit(i: int) -> list:
            mae = errors(i)
            return [({**texts[i], **({"maxIter": str(r)} if "maxIter" in grid else {})}, held, mae.get(r)) for r in rounds]

        return [row for i, point in enumerate(points) for row in finished.get([point, held], lambda i=i: fit(i))]

    groups: dict[str, list[dict]] = {}
    for point in shared:
        groups.setdefault(str({k: v for k, v in point.items() if k != "minInfoGain"}), []).append(point)
    cores = spark.sparkContext.defaultParallelism
    with ThreadPoolExecutor(parallelism if tasks is None else max(parallelism, cores)) as pool:
        table = [row for rows_of in pool.map(one, itertools.product(groups.values(), range(folds))) for row in rows_of]
    scored = spark.createDataFrame(table, _FOLDS)
    names = sorted(grid)
    flat = scored.select(*[F.col("params")[n].alias(n) for n in names], "mae").groupBy(*names).agg(F.avg("mae").alias("mae"))
    return flat.select(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("params"), "mae")


def gain_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Mean gain per split and splits of every feature that the trees use (feature, importance, splits)."""
    return forest.gain_table(model.stages[-1], features, spark)
