"""Tree attributions: how much each feature moves each prediction, as a distributed job.

Path-dependent Shapley values of a boosted tree model. For one leaf with value v, let each feature
j on its path have o_j = 1 when the row meets all of the path's conditions on j (else 0) and z_j =
the share of training rows that pass those conditions. Its Shapley value for feature i is

    v * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (o_j * t + z_j * (1 - t)) dt

because the Shapley weight k! (d - 1 - k)! / d! equals the integral of t^k (1 - t)^(d - 1 - k). The
integrand is a polynomial, so Gauss-Legendre points give the integral exactly. Values add up:
expected value + sum of attributions = prediction.

The model is small (trees * nodes) and goes to the executors with the function; rows are read,
attributed and emitted by Spark partition by partition.

What a leaf gives depends only on which conditions of its path a row meets. Leaves next to each other share most
of them, so a few leaves together have at most ``CONDITIONS`` conditions, and a table of what they give to each
feature for every outcome of these. A row then costs a look into each table. The tables come from the sum above,
taken over the outcomes instead of the rows. Leaves with more conditions on their own path than that meet the
rows themselves: they are kept as padded arrays, one set for each number of features on their paths, and a
block of rows meets a block of leaves at a time, so the memory of a task is bounded whatever the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.schema import q
from paceforge.session import staging_path


@dataclass(frozen=True)
class Path:
    """One leaf: per feature the interval (low, high] its path allows and the share passing it."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaf_paths(model: PipelineModel, spark: SparkSession) -> list[Path]:
    """Leaf paths of a fitted boosted-tree model, read from its saved node table."""
    trees = model.stages[-1]
    path = staging_path(spark, "trees")
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = list(trees.treeWeights)
    by_tree: dict[int, dict[int, object]] = {}
    for row in nodes.collect():  # bounded by the model, not by the data
        by_tree.setdefault(row["treeID"], {})[row["id"]] = row
    paths: list[Path] = []
    for tree, members in sorted(by_tree.items()):
        _walk(members, 0, {}, weights[tree], paths)
    return paths


def _walk(nodes: dict, at: int, bounds: dict, weight: float, out: list[Path]) -> None:
    node = nodes[at]
    if node["leftChild"] < 0:
        names = sorted(bounds)
        out.append(
            Path(
                np.array(names, dtype=np.int64),
                np.array([bounds[f][0] for f in names]),
                np.array([bounds[f][1] for f in names]),
                np.array([bounds[f][2] for f in names]),
                weight * node["prediction"],
            )
        )
        return
    feature = node["split"]["featureIndex"]
    threshold = node["split"]["leftCategoriesOrThreshold"][0]
    low, high, share = bounds.get(feature, (-np.inf, np.inf, 1.0))
    for child, lo, hi in (
        (node["leftChild"], low, min(high, threshold)),
        (node["rightChild"], max(low, threshold), high),
    ):
        passing = share * nodes[child]["rawCount"] / node["rawCount"]
        _walk(nodes, child, {**bounds, feature: (lo, hi, passing)}, weight, out)


def expected_value(paths: Sequence[Path]) -> float:
    return float(sum(p.value * p.share.prod() for p in paths))


@dataclass(frozen=True)
class Leaves:
    """Leaves whose paths hold the same number of features: arrays of (leaf, feature on the path).

    They are sorted by their features, so that leaves of one feature set lie together.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_arrays(paths: Sequence[Path]) -> list[Leaves]:
    """The leaves by the number of features on their paths; a leaf without any moves nothing."""
    groups: dict[int, list[Path]] = {}
    for p in paths:
        if len(p.features):
            groups.setdefault(len(p.features), []).append(p)
    out = []
    for _, members in sorted(groups.items()):
        members = sorted(members, key=lambda p: p.features.tolist())
        stacked = (np.stack([getattr(p, c) for p in members]) for c in ("features", "low", "high", "share"))
        out.append(Leaves(*stacked, np.array([p.value for p in members])))
    return out


#: Cells (rows x leaves x features on a path) that are held at once.
BLOCK_CELLS = 2_000_000


def attribute(x: np.ndarray, paths: Sequence[Path] | Sequence[Leaves], cells: int = BLOCK_CELLS) -> np.ndarray:
    """Attributions of rows (rows x features)."""
    groups = paths if len(paths) and isinstance(paths[0], Leaves) else leaf_arrays(paths)
    out = np.zeros(x.shape)
    for g in groups:
        d = g.features.shape[1]
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        leaves = max(1, min(len(g.value), cells // (d * 64)))
        rows = max(1, cells // (d * leaves))
        for at in range(0, len(g.value), leaves):
            part = slice(at, at + leaves)
            names, share, value = g.features[part], g.share[part], g.value[part]
            # adds up the columns of a feature; one column for each leaf and place on its path
            used, place = np.unique(names, return_inverse=True)
            gather = np.zeros((names.size, len(used)))
            gather[np.arange(names.size), place.ravel()] = 1
            for r in range(0, len(x), rows):
                seen = x[r : r + rows][:, names]
                meets = (seen > g.low[part]) & (seen <= g.high[part])
                others = np.zeros(meets.shape)
                for t, w in zip((points + 1) / 2, weights / 2):
                    factors = np.where(meets, t + share * (1 - t), share * (1 - t))
                    others += w * factors.prod(axis=2)[:, :, None] / factors
                moved = value[:, None] * (meets - share) * others
                out[r : r + rows, used] += moved.reshape(len(seen), -1) @ gather
    return out


#: Conditions that a table covers, and numbers in the tables that a task keeps.
CONDITIONS, KEPT_NUMBERS = 8, 8_000_000


@dataclass(frozen=True)
class Group:
    """Leaves and the conditions of their paths: whether ``features[k]`` of a row is above ``cuts[k]``."""

    features: np.ndarray
    cuts: np.ndarray
    paths: tuple[Path, ...]

    def used(self) -> np.ndarray:
        return np.unique(self.features)

    def table(self) -> np.ndarray:
        """What the leaves give to each of the used features (rows) at each outcome of the conditions."""
        used, size = self.used(), len(self.cuts)
        above = (np.arange(2**size)[:, None] >> np.arange(size)) & 1 == 1
        # a value of every outcome; outcomes that no value has are never looked up
        rows = np.zeros((len(above), used[-1] + 1))
        for f in used:
            mine = np.flatnonzero(self.features == f)
            mine = mine[np.argsort(self.cuts[mine])]
            steps = np.append(self.cuts[mine], np.inf)
            rows[:, f] = steps[above[:, mine].sum(axis=1)]
        return np.ascontiguousarray(attribute(rows, self.paths)[:, used].T)


@dataclass(frozen=True)
class Tables:
    """Groups of leaves and the leaves that no group takes."""

    groups: tuple[Group, ...]
    rest: tuple[Leaves, ...]


def _conditions(path: Path) -> set[tuple[int, float]]:
    cuts = [*zip(path.features.tolist(), path.low.tolist()), *zip(path.features.tolist(), path.high.tolist())]
    return {c for c in cuts if np.isfinite(c[1])}


def leaf_groups(paths: Sequence[Path], most: int = CONDITIONS) -> Tables:
    """Leaves in their order, as many together as have ``most`` conditions; a leaf without any moves nothing."""
    groups: list[tuple[set, list[Path]]] = []
    rest: list[Path] = []
    for p in paths:
        mine = _conditions(p)
        if len(mine) > most:
            rest.append(p)
        elif mine and groups and len(groups[-1][0] | mine) <= most:
            groups[-1] = (groups[-1][0] | mine, [*groups[-1][1], p])
        elif mine:
            groups.append((mine, [p]))
    out = []
    for found, members in groups:
        cuts = sorted(found)
        out.append(Group(np.array([f for f, _ in cuts]), np.array([c for _, c in cuts]), tuple(members)))
    return Tables(tuple(out), tuple(leaf_arrays(rest)))


class Lookup:
    """Attributions by the tables of a model, built when they are first needed."""

    def __init__(self, tables: Tables, kept: int = KEPT_NUMBERS):
        self.tables, self.kept = tables, kept
        cuts = sorted({c for g in tables.groups for c in zip(g.features.tolist(), g.cuts.tolist())})
        place = {c: i for i, c in enumerate(cuts)}
        self.cuts = cuts
        self.places = [[place[c] for c in zip(g.features.tolist(), g.cuts.tolist())] for g in tables.groups]
        self.built: dict[int, tuple[list[int], np.ndarray]] = {}

    def _table(self, k: int) -> tuple[list[int], np.ndarray]:
        if k in self.built:
            return self.built[k]
        group = self.tables.groups[k]
        made = (group.used().tolist(), group.table())
        if made[1].size <= self.kept:
            self.kept -= made[1].size
            self.built[k] = made
        return made

    def __call__(self, x: np.ndarray, cells: int = 4 * BLOCK_CELLS) -> np.ndarray:
        """Attributions of rows (rows x features)."""
        out = attribute(x, self.tables.rest)
        rows = max(1, cells // max(1, len(self.cuts)))
        for at in range(0, len(x) if self.cuts else 0, rows):
            columns = np.ascontiguousarray(x[at : at + rows].T)
            above = [(~(columns[f] <= cut)).view(np.uint8) for f, cut in self.cuts]
            moved = np.zeros(columns.shape)
            for k, places in enumerate(self.places):
                outcome = np.zeros(columns.shape[1], np.uint16)
                for bit, c in enumerate(places):
                    outcome += above[c].astype(np.uint16) << bit
                outcome = outcome.astype(np.intp)
                for f, given in zip(*self._table(k)):
                    moved[f] += given[outcome]
            out[at : at + rows] += moved.T
        return out


def attributions(
    model: PipelineModel,
    rows: DataFrame,
    features: Sequence[str],
    keep: Sequence[str] = ("activity_id",),
    paths: Sequence[Path] | None = None,
) -> DataFrame:
    """Long table (kept columns, feature, value, shap) for every row and feature.

    ``paths`` may hold the :func:`leaf_paths` of the model.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(leaf_groups(leaf_paths(model, spark) if paths is None else paths))

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = Lookup(shared.value)
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(features)))
            yield pd.Series(list(look(x)))

    inputs = PipelineModel(stages=model.stages[:-1]).transform(rows)
    x = inputs.select(*map(q, keep), vector_to_array("features").alias("_x"))
    explained = x.withColumn("_shap", explain("_x"))
    names = F.array(*[F.lit(f) for f in features])
    zipped = F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_shap").alias("shap"))
    long = explained.select(*map(q, keep), F.explode(zipped).alias("e"))
    return long.select(
        *map(q, keep), F.col("e")["feature"].alias("feature"), F.col("e")["value"].alias("value"), F.col("e")["shap"].alias("shap")
    )
