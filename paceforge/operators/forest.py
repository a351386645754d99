"""The trees of a fitted boosted model as a table, and what follows from it: error per round, shorter models,
importances.

A model is small next to the data (rounds x nodes). Its node table stays a DataFrame where it is aggregated
and becomes padded arrays where rows walk through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.session import staging_path


def node_table(trees: GBTRegressionModel, spark: SparkSession) -> DataFrame:
    """(tree, node, feature, threshold, gain, rows, prediction, left, right, weight); leaves have no feature."""
    path = staging_path(spark, "trees")
    trees.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node["leftChild"] >= 0
    weights = F.array(*[F.lit(float(w)) for w in trees.treeWeights])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["gain"]).alias("gain"),
        node["rawCount"].cast("double").alias("rows"),
        node["prediction"].alias("prediction"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        F.get(weights, F.col("treeID")).alias("weight"),
    )


def gain_table(trees: GBTRegressionModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Mean gain per split, the squared error it takes away, and number of splits (feature, importance, splits).

    Features without a split that gains anything are left out.
    """
    names = F.array(*[F.lit(f) for f in features])
    used = node_table(trees, spark).filter("feature IS NOT NULL AND gain > 0")
    grouped = used.groupBy("feature").agg(F.avg(F.col("gain") * F.col("rows")).alias("importance"), F.count(F.lit(1)).alias("splits"))
    return grouped.select(F.get(names, F.col("feature")).alias("feature"), "importance", "splits")


@dataclass(frozen=True)
class Forest:
    """All trees side by side: node arrays of (tree, node); a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(nodes: DataFrame) -> Forest:
        rows = nodes.collect()  # bounded by the model
        trees, most = 1 + max(r["tree"] for r in rows), 1 + max(r["node"] for r in rows)
        feature, left, right = (np.zeros((trees, most), np.int64) for _ in range(3))
        threshold, value = np.zeros((trees, most)), np.zeros((trees, most))
        for r in rows:
            t, n = r["tree"], r["node"]
            leaf = r["feature"] is None
            feature[t, n] = 0 if leaf else r["feature"]
            threshold[t, n] = np.inf if leaf else r["threshold"]
            left[t, n], right[t, n] = (n, n) if leaf else (r["left"], r["right"])
            value[t, n] = r["prediction"] * r["weight"]
        depth, level = 0, np.zeros((trees, 1), np.int64)
        while True:
            below = np.stack([np.take_along_axis(c, level, 1) for c in (left, right)]).transpose(1, 0, 2).reshape(trees, -1)
            below = np.unique(below, axis=1)
            if below.shape == level.shape and (below == level).all():
                return Forest(feature, threshold, left, right, value, depth)
            level, depth = below, depth + 1

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """What every tree adds to the prediction of each row (rows x trees)."""
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            split = np.take_along_axis(x, self.feature[tree, at], axis=1)
            at = np.where(split <= self.threshold[tree, at], self.left[tree, at], self.right[tree, at])
        return self.value[tree, at]


def round_errors(trees: GBTRegressionModel, rows: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """Error of the first k rounds for every k, in one pass: round, n, mae, rmse."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Forest.of(node_table(trees, spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        count, total, squares = 0, 0.0, 0.0
        block = max(1, 4_000_000 // len(forest.feature))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if len(y) else np.zeros((0, 1))
            for at in range(0, len(y), block):
                error = np.cumsum(forest.contributions(x[at : at + block]), axis=1) - y[at : at + block, None]
                count, total, squares = count + len(error), total + np.abs(error).sum(axis=0), squares + (error**2).sum(axis=0)
        if count:
            n = len(forest.feature)
            yield pa.RecordBatch.from_pydict(
                {"round": np.arange(1, n + 1), "n": np.full(n, count), "absolute": total, "squares": squares}
            )

    used = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    parts = used.mapInArrow(run, "round long, n long, absolute double, squares double")
    return parts.groupBy("round").agg(
        F.sum("n").alias("n"), (F.sum("absolute") / F.sum("n")).alias("mae"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse")
    )


def best_round(errors: Sequence[float], patience: int) -> int:
    """Rounds to keep: the first lowest error before ``patience`` rounds in a row brought no lower one."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_rounds(trees: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The same model with its first trees only; all parameters are kept."""
    java = trees._java_obj
    if rounds >= len(trees.treeWeights):
        return trees
    context = SparkContext._active_spark_context  # also in the threads of a search
    jvm, gateway = context._jvm, context._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    members, weights = gateway.new_array(kind, rounds), gateway.new_array(jvm.double, rounds)
    for k in range(rounds):
        members[k], weights[k] = java.trees()[k], float(trees.treeWeights[k])
    short = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), members, weights, java.numFeatures())
    return GBTRegressionModel._from_java(java.copyValues(short, java.extractParamMap()))

