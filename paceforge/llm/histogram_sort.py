"""Sharding by histogram sort: contiguous key ranges of near-equal bytes, found by counting.

Candidate boundaries (probes) are laid between the smallest and the largest key. One job per round
counts the exact bytes and rows below every probe; the interval around each splitter shrinks until a
probe meets the tolerance or no key lies between its ends. Only the probe counts reach the driver,
a number set by shards and probes, never by rows. The rows then move once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.llm.common import Tables
from paceforge.session import stage

#: A sort key is the pair (key, tie) as one integer, so that equal keys can be cut as well.
_TIE = 1 << 63
_LOW = -(1 << 63)


@dataclass
class _Splitter:
    target: int  # bytes that should lie below
    slack: int
    low: int  # probe with at most target bytes below it
    high: int  # probe with at least target bytes below it
    found: int | None = None


def _pack(key: int, tie: int) -> int:
    return key * _TIE + tie


def _count_below(table: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact (bytes, rows) below each probe. ``table`` has key, tie and size."""
    keys = np.array([p // _TIE for p in probes], np.int64)
    ties = np.array([p % _TIE for p in probes], np.int64)
    n = len(probes)

    def run(batches: Tables) -> Tables:
        size, rows = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for batch in batches:
            key, tie, width = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(keys, key, "left")  # probes with a smaller key
            end = np.searchsorted(keys, key, "right")
            for first in np.unique(at[at < end]):  # rows whose key is a probe's: the tie decides
                own = np.flatnonzero((at == first) & (at < end))
                at[own] = first + np.searchsorted(ties[first : end[own[0]]], tie[own], "right")
            np.add.at(size, at, width)
            np.add.at(rows, at, 1)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(full, pa.int32()), "size": size[full], "rows": rows[full]})

    parts = table.select("key", "tie", "size").mapInArrow(run, "cell int, size long, rows long")
    size, rows = [0] * (n + 1), [0] * (n + 1)
    for cell, s, r in parts.groupBy("cell").agg(F.sum("size"), F.sum("rows")).collect():
        size[cell], rows[cell] = s, r
    below, b, r = {}, 0, 0
    for i, probe in enumerate(probes):
        b, r = b + size[i], r + rows[i]
        below[probe] = (b, r)
    return below


def find_splitters(
    table: DataFrame, n_cells: int, n_shards: int, tolerance: float, probes: int = 12
) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """n_cells - 1 boundaries over (key, tie), every (n_cells / n_shards)-th a shard's, and the counts below them.

    Shard boundaries are refined to ``tolerance`` of a shard's bytes, the cells inside a shard to a
    quarter of a cell. Where no row boundary is that near, the nearest one is taken.
    """
    total, rows, least, most = table.agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if not rows:
        return [_pack(0, 0)] * (n_cells - 1), {_pack(0, 0): (0, 0)}
    bottom, top = _pack(least, 0), _pack(most, _TIE - 1)
    counts = {bottom: (0, 0), top: (total, rows)}
    per = n_cells // n_shards
    splitters = [
        _Splitter(
            total * i // n_cells,
            int(tolerance * total / n_shards) if i % per == 0 else total // n_cells // 4,
            bottom,
            top,
        )
        for i in range(1, n_cells)
    ]
    open_ = list(splitters)
    while open_:
        wanted = set()
        for s in open_:
            step = max(1, (s.high - s.low) // (probes + 1))
            wanted.update(range(s.low + step, s.high, step))
        if wanted:
            counts |= _count_below(table, sorted(wanted))
        known = sorted(counts)
        for s in open_:
            inside = [p for p in known if s.low <= p <= s.high]
            s.low = max(p for p in inside if counts[p][0] <= s.target)
            s.high = min(p for p in inside if counts[p][0] >= s.target)
            best = min((s.low, s.high), key=lambda p: abs(counts[p][0] - s.target))
            near = abs(counts[best][0] - s.target) <= s.slack
            whole = counts[s.high][1] - counts[s.low][1] <= 1  # one row or none between: it can't be cut
            if near or whole or s.high - s.low <= 1:
                s.found = best
        open_ = [s for s in open_ if s.found is None]
    # The nearest row boundary never falls as the target grows; slack keeps accepted probes in order as well.
    bounds = sorted(s.found for s in splitters)
    return bounds, counts


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 40,
    overhead: int = 16,
    tolerance: float = 0.002,
    cells_per_shard: int | None = None,
    whole_rows: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its shard of near-equal bytes, in doc_id order.

    Columns: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard),
    grown_shard (null: this law has none); with ``whole_rows`` also ``doc``, a struct of all columns of
    ``docs``. Size is the UTF-8 bytes of the text plus ``overhead``.

    Null text: no bytes, checksum 0. Null doc_id: sorts first, just below the smallest. Equal doc_ids are cut between rows by
    their position in the staged table, so a key with a third of all rows still splits. An empty table
    gives no rows; other columns don't matter. Shards are subdivided into cells that are sorted apart,
    so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # a key far from all others would cost a counting round for every few bits of the distance
    least = docs.agg(F.min(F.col("doc_id").cast("long"))).first()[0]
    missing = _LOW if least is None or least == _LOW else least - 1
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole_rows else []
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(missing)).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
        *whole,
    )
    table = stage(rows, "shard-keys")
    if cells_per_shard is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells_per_shard = max(1, -(-parts // n_shards))
    n_cells = n_shards * cells_per_shard
    bounds, counts = find_splitters(table, n_cells, n_shards, tolerance)
    keys = np.array([b // _TIE for b in bounds], np.int64)
    ties = np.array([b % _TIE for b in bounds], np.int64)
    below = np.array([0] + [counts[b][1] for b in bounds], np.int64)

    def place(batches: Tables) -> Tables:
        for batch in batches:
            key, tie = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("key", "tie"))
            at = np.searchsorted(keys, key, "left")
            end = np.searchsorted(keys, key, "right")
            for first in np.unique(at[at < end]):
                own = np.flatnonzero((at == first) & (at < end))
                at[own] = first + np.searchsorted(ties[first : end[own[0]]], tie[own], "right")
            shard = at // cells_per_shard
            before = below[at] - below[shard * cells_per_shard]  # rows of the shard in earlier cells
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int32()), pa.array(shard, pa.int32()), pa.array(before, pa.int64())],
                names=[*batch.schema.names, "cell", "shard", "before"],
            )

    id_type = dict(table.dtypes)["doc_id"]
    kept = f"doc {dict(table.dtypes)['doc']}, " if whole_rows else ""
    placed = table.mapInArrow(
        place,
        f"doc_id {id_type}, size long, text_crc32 long, key long, tie long, {kept}cell int, shard int, before long",
    )
    within = F.row_number().over(Window.partitionBy("cell").orderBy("key", "tie"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + within - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["doc"] if whole_rows else []),
    )
