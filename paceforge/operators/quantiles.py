"""Exact medians of large columns, in at most three reads.

The built-in exact percentile merges every distinct value into one task. Here a mergeable quantile sketch
brackets the middle ranks in the first read: its error is a known share of the rows, so a bracket a little
wider than that share surely holds them, whatever the values. A second sketch inside the bracket (left out
where the bracket is small) narrows it by the same share again. The last read counts what lies below and
gathers the few values inside.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.schema import q

GATHER_LIMIT = 20_000
#: Ranks of a sketch are off by at most one part in so many of its rows.
ACCURACY = 5_000


@dataclass
class _Bracket:
    """The middle rows, zero-based ``ranks`` of all, have values within [low, high]."""

    ranks: tuple[int, int]
    low: float
    high: float
    most: float  # bound of the rows inside
    answer: float | None = None


def exact_medians(
    df: DataFrame, columns: Sequence[str], gather_limit: int = GATHER_LIMIT, accuracy: int = ACCURACY
) -> dict[str, float | None]:
    """Median per column over finite values, the mean of the two middle ones for even counts.

    The last read gathers the distinct values of the final brackets: up to ``gather_limit`` rows a column, or
    about forty parts in ``accuracy`` squared of all rows where that is more.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = df.select(*[F.col(q(c)).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    state = _first_sketch(values, len(columns), accuracy)
    wide = {i: b for i, b in state.items() if b.answer is None and b.most > gather_limit}
    if wide:
        _second_sketch(values, wide, accuracy)
    _gather(values, {i: b for i, b in state.items() if b.answer is None})
    return {c: state[i].answer if i in state else None for i, c in enumerate(columns)}


def _finite(i: int):
    c = F.col(f"_{i}")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _first_sketch(values: DataFrame, n: int, accuracy: int) -> dict[int, _Bracket]:
    margin = 2 / accuracy
    sketch = [F.percentile_approx(_finite(i), [0.5 - margin, 0.5 + margin], accuracy).alias(f"p{i}") for i in range(n)]
    row = values.agg(*sketch, *[F.count(_finite(i)).alias(f"n{i}") for i in range(n)]).first()
    out = {}
    for i in range(n):
        if rows := row[f"n{i}"]:
            low, high = row[f"p{i}"]
            # both ends may be off by a part, and ranks are whole
            out[i] = _Bracket(((rows - 1) // 2, rows // 2), low, high, 6 * rows / accuracy + 4, low if low == high else None)
    return out


def _second_sketch(values: DataFrame, brackets: dict[int, _Bracket], accuracy: int) -> None:
    grid = [k / accuracy for k in range(accuracy + 1)]
    wanted = []
    for i, b in brackets.items():
        v = _finite(i)
        inside = F.when(v.between(b.low, b.high), v)
        wanted += [
            F.count_if(v < b.low).alias(f"b{i}"),
            F.count(inside).alias(f"n{i}"),
            F.percentile_approx(inside, grid, accuracy).alias(f"p{i}"),
        ]
    row = values.agg(*wanted).first()
    for i, b in brackets.items():
        below, inside, points = row[f"b{i}"], row[f"n{i}"], row[f"p{i}"]
        first, last = (rank - below for rank in b.ranks)
        # two parts of room on either side: one for the sketch, one for the grid
        at = int(first * accuracy / inside) - 2
        to = int((last + 1) * accuracy / inside) + 3
        b.low = points[at] if at >= 0 else b.low
        b.high = points[to] if to <= accuracy else b.high
        b.answer = b.low if b.low == b.high else None


def _gather(values: DataFrame, brackets: dict[int, _Bracket]) -> None:
    """Exact counts: rows below the bracket under a null value, and every value inside."""
    if not brackets:
        return
    entries = []
    for i, b in brackets.items():
        v = _finite(i)
        entries.append(F.when(v <= b.high, F.struct(F.lit(i).alias("i"), F.when(v >= b.low, v).alias("v"))))
    counts = (
        values.select(F.explode(F.array(*entries)).alias("e"))
        .filter("e IS NOT NULL")
        .groupBy("e.i", "e.v")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("i", F.asc_nulls_first("v"))
        .collect()  # as many rows as distinct values inside the brackets
    )
    for i, b in brackets.items():
        seen, found = 0, {}
        for row in (r for r in counts if r["i"] == i):
            for rank in b.ranks:
                if seen <= rank < seen + row["n"]:
                    found[rank] = row["v"]
            seen += row["n"]
        b.answer = _middle(found[b.ranks[0]], found[b.ranks[1]])


def _middle(a: float, b: float) -> float:
    return a if a == b else a / 2 + b / 2 if abs(a) > 1e307 or abs(b) > 1e307 else (a + b) / 2
