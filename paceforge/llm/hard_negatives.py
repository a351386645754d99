"""Hard negatives by a vertical scan with bounds (BOND).

Vectors are cut into row pieces and anchors into blocks; every piece meets every block once, as one group
of a cogrouped join, so no task holds more than a piece and a block, and hot ids or labels don't matter. In
a group the vectors lie dimension by dimension. Each anchor reads the dimensions in descending magnitude of
its own components, a few at a time. What the unread dimensions can still add lies between bounds taken
from each dimension's least and largest value in the piece, so every row has a lower and an upper bound for
its inner product. Rows whose bounds rule them out leave the candidate bitmap; the rest end with exact
integer products. The first scan finds each anchor's positives, the second its negatives, for all score
windows of the anchor at once. Groups return their best rows, and a window over the anchor merges them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.session import stage

#: Dimensions read between two looks at the bounds.
STEP = 8


def usable(vector: str, *required: str) -> Column:
    """Rows with all ``required`` columns and a vector of finite components only."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.col(vector).isNotNull() & ~bad
    for c in required:
        out = out & F.col(c).isNotNull()
    return out


def matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x), one row per dimension; vectors shorter than ``width`` count as zero there."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), width).T)
    out = np.zeros((width, len(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


def exact_type(*parts: np.ndarray) -> type:
    """Smallest float type whose integer sums are exact for inner products of these parts."""
    largest = [float(np.abs(p).max()) if p.size else 0.0 for p in parts]
    reach = largest[0] * largest[-1] * max(1, parts[0].shape[0])
    if reach < 2**24:
        return np.float32
    if reach < 2**53:
        return np.float64
    raise ValueError("inner products of these vectors are too large to be exact")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Scan:
    """Columns of one piece that an anchor may pick from, with each dimension's range."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray):
        self.columns, self.ids = columns, ids
        self.low = columns.min(axis=1) if columns.shape[1] else np.zeros(len(columns))
        self.high = columns.max(axis=1) if columns.shape[1] else np.zeros(len(columns))

    def products(self, anchor: np.ndarray, own_id: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact products of the rows that ``wanted(lower, upper)`` never ruled out.

        ``wanted`` gets bounds of the rows still in the bitmap and returns which of them stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least, most = np.minimum(a, b).astype(np.float64), np.maximum(a, b).astype(np.float64)
        least, most = np.append(least[::-1].cumsum()[::-1], 0), np.append(most[::-1].cumsum()[::-1], 0)
        bitmap = self.ids != own_id
        sums = np.zeros(len(self.ids), self.columns.dtype)
        at = None if bitmap.all() else np.flatnonzero(bitmap)
        if at is not None:
            sums = sums[at]
        for start in range(0, len(order), STEP):
            dims = order[start : start + STEP]
            part = self.columns[dims] if at is None else self.columns[np.ix_(dims, at)]
            sums += anchor[dims] @ part
            done = min(start + STEP, len(order))
            keep = wanted(sums + least[done], sums + most[done])
            if not keep.all():
                at = np.flatnonzero(keep) if at is None else at[keep]
                sums = sums[keep]
            if not len(sums):
                break
        return (np.arange(len(self.ids)) if at is None else at), sums


def top_by_bound(k: int):
    """Keep rows that may still be among the k highest."""

    def wanted(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return wanted


def windows_by_bound(windows: Sequence[tuple[int, int]], k: int):
    """Keep rows that may still be among the k highest inside one of the windows (both ends included)."""

    def wanted(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for lo, hi in windows:
            may = (upper >= lo) & (lower <= hi)
            sure = lower[(lower >= lo) & (upper <= hi)]
            if len(sure) >= k:
                may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= may
        return keep

    return wanted


def _load(piece: pa.Table, block: pa.Table, scale: float):
    sides = piece["x"].combine_chunks(), block["anchor_x"].combine_chunks()
    width = max(pa.compute.max(side.value_lengths()).as_py() for side in sides)
    rows, anchors = matrix(sides[0], width, scale), matrix(sides[1], width, scale).T
    kind = exact_type(rows, anchors.T)
    return rows.astype(kind), np.ascontiguousarray(anchors.astype(kind))


def _by_label(rows: np.ndarray, piece: pa.Table, block: pa.Table, same: bool):
    """(scan, anchor places) per anchor label: the piece's rows of that label, or all others."""
    ids, labels = piece["vec_id"].to_numpy(), piece["label"].to_numpy()
    mine = block["anchor_label"].to_numpy()
    for label in np.unique(mine):
        at = np.flatnonzero((labels == label) == same)
        if len(at):
            yield Scan(np.ascontiguousarray(rows[:, at]), ids[at]), np.flatnonzero(mine == label)


def _positives(k: int, scale: float):
    def run(piece: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(piece) and len(block):
            rows, anchors = _load(piece, block, scale)
            keys, own = block["anchor"].to_numpy(), block["anchor_id"].to_numpy()
            for scan, places in _by_label(rows, piece, block, same=True):
                for i in places:
                    at, scores = scan.products(anchors[i], own[i], top_by_bound(k))
                    for j in best(scores, scan.ids[at], k):
                        out.append((int(keys[i]), int(scan.ids[at[j]]), int(scores[j])))
        return _table(out, ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int, scale: float):
    def run(piece: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(piece) and len(block):
            rows, anchors = _load(piece, block, scale)
            keys, own = block["anchor"].to_numpy(), block["anchor_id"].to_numpy()
            found = block["found"].to_pylist()
            for scan, places in _by_label(rows, piece, block, same=False):
                for i in places:
                    spans = [(-(-low * p["s"] // 100), high * p["s"] // 100) for p in found[i]]
                    open_spans = sorted({s for s in spans if s[0] <= s[1]})
                    if not open_spans:
                        continue
                    at, scores = scan.products(anchors[i], own[i], windows_by_bound(open_spans, k))
                    for p, (lo, hi) in zip(found[i], spans):
                        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                        for j in inside[best(scores[inside], scan.ids[at[inside]], k)]:
                            out.append((int(keys[i]), p["r"], int(scan.ids[at[j]]), int(scores[j])))
        return _table(out, ["anchor", "place", "negative_id", "negative_score"])

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _best_rows(df: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(
    vectors: DataFrame,
    anchors: Column,
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    piece_rows: int = 32_768,
    block_rows: int = 16_384,
) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` is true, against all rows of ``vectors``.

    ``vectors`` has ``vec_id``, ``label`` and the vector column. A component x counts as floor(scale * x);
    scores are exact inner products of these integers, and a ValueError is raised where they would pass
    2^53. An anchor's positives are its ``positives`` highest-scoring other rows of the same label, ties by
    smaller id. For each, the ``negatives`` highest rows of other labels whose score lies between ``low``
    and ``high`` per cent of the positive's are returned, both ends included: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score, positive_rank.

    Rows without an id or label, without a vector or with a null, NaN or infinite component take no part.
    Vectors of unequal length count as padded with zeros. Repeated ids: each row takes part on its own, but
    rows with the anchor's id are never its partners. Positive scores below zero leave an empty window.
    Other columns are ignored. ``piece_rows`` and ``block_rows`` bound a task's memory, not the result.
    """
    chosen = vectors.filter(usable(vector, "vec_id", "label")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col(vector).alias("x"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(chosen, "vectors")  # pins the row numbers that deal rows to pieces
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    spread = min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // 2_048))
    pieces = max(1, spread, -(-total // piece_rows))
    blocks = max(1, -(-asking // block_rows))

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")

    left = rows.select(
        "vec_id", "label", "x", dealt("row", pieces).alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    ).groupBy("piece", "block")

    def against(asks: DataFrame, run, schema: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
        right = asks.select("*", dealt("anchor", blocks).alias("block"), every)
        return left.cogroup(right.groupBy("piece", "block")).applyInArrow(run, schema)

    asks = rows.filter("asks").select(
        F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("x").alias("anchor_x")
    )
    near = against(asks, _positives(positives, scale), "anchor long, positive_id long, positive_score long")
    near = stage(_best_rows(near, ["anchor"], "positive_score", "positive_id", positives, "place"), "positives")

    found = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("place").alias("r"), F.col("positive_score").alias("s"))).alias("found"))
    far = against(
        asks.join(found, "anchor"), _negatives(negatives, low, high, scale), "anchor long, place long, negative_id long, negative_score long"
    )
    far = _best_rows(far, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    named = near.join(asks.select("anchor", "anchor_id"), "anchor")
    return far.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("place").alias("positive_rank")
    )
