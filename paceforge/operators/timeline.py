"""Per-runner history: previous runs, lags, gaps, trailing 7/30-day features, sequences.

``Keys`` names the entity, time and tie-break columns. Row windows order by (time, tie); trailing
windows are value ranges over time alone, so activities sharing a timestamp get the same values.
Rows without entity or time are kept and get nulls.

The plain plans are one exchange per entity. Entities above ``SplitPolicy.max_rows`` go through
chunked plans (see ``operators/skew.py``) that give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from paceforge import schema
from paceforge.functions import calendar
from paceforge.operators import exact_sums, quantiles, skew
from paceforge.operators.exact_sums import Limbs
from paceforge.operators.skew import CHUNK, DEFAULT_POLICY, SHARD, SplitPolicy
from paceforge.schema import q
from paceforge.session import stage

WIDTHS = (7, 30)


@dataclass(frozen=True)
class Keys:
    entity: str = "runner_id"
    time: str = "date"
    tie: str = "activity_id"


RUNS = Keys()
WindowColumns = Callable[[WindowSpec], Mapping[str, Column]]


# ---------------------------------------------------------------- row windows


def _row_window(keys: Keys, *partition: str) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(keys.time, keys.tie)


def _plain_rows(df: DataFrame, make: WindowColumns, keys: Keys) -> DataFrame:
    """Needs the shard column; windows of several calls share its exchange and sort."""
    columns = make(_row_window(keys, keys.entity, SHARD))
    return df.withColumns(
        {n: skew.dated_only(c, keys.entity, keys.time) for n, c in columns.items()}
    )


def _chunked_rows(
    df: DataFrame, make: WindowColumns, back: int, ahead: int, keys: Keys
) -> DataFrame:
    """Row windows over chunks. ``back``/``ahead`` are how far a row looks.

    A row with enough neighbours in its own chunk is final there. The rows near the chunk borders
    are recomputed over the borders of all chunks of the entity put together, a few rows per chunk.
    """
    reach = back + ahead
    local = _row_window(keys, keys.entity, CHUNK)
    one = F.lit(1)

    def neighbours(before: int, after: int) -> Column:
        has = F.lit(True)
        if before:
            has = has & F.lag(one, before).over(local).isNotNull()
        if after:
            has = has & F.lead(one, after).over(local).isNotNull()
        return has

    flagged = df.withColumns(
        {"_final": neighbours(back, ahead), "_inner": neighbours(reach, reach)}
    )
    body = flagged.withColumns(dict(make(local))).filter("_final")
    border = flagged.filter("NOT _inner").withColumns(dict(make(_row_window(keys, keys.entity))))
    return body.unionByName(border.filter("NOT _final")).drop("_final", "_inner")


def _chunk_history(parts: skew.Parts, keys: Keys, policy: SplitPolicy) -> DataFrame:
    order = [keys.entity, keys.time, keys.tie]
    return skew.range_chunks(parts.oversized, order, parts.oversized_rows, policy, "history")


def add_row_windows(
    df: DataFrame,
    make: WindowColumns,
    back: int = 0,
    ahead: int = 0,
    keys: Keys = RUNS,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    parts = skew.split_oversized(df, keys.entity, keys.time, policy)
    sharded = skew.with_shard(parts.ordinary, keys.entity, keys.time, keys.tie)
    out = _plain_rows(sharded, make, keys).drop(SHARD)
    if parts.oversized is not None:
        chunks = _chunk_history(parts, keys, policy)
        out = out.unionByName(_chunked_rows(chunks, make, back, ahead, keys).drop(CHUNK))
    return out


def previous_columns(sources: Mapping[str, str]) -> WindowColumns:
    """``{source: stem}`` to ``<stem>_previous`` columns."""
    return lambda w: {f"{stem}_previous": F.lag(q(c), 1).over(w) for c, stem in sources.items()}


def lag_columns(sources: Mapping[str, str], lags: int) -> WindowColumns:
    return lambda w: {
        f"{stem}_t-{k}": F.lag(q(c), k).over(w)
        for k in range(1, lags + 1)
        for c, stem in sources.items()
    }


def gap_columns(time: str) -> WindowColumns:
    return lambda w: {
        "days_since_last_run": calendar.elapsed_days(F.lag(time, 1).over(w), F.col(time))
    }


def combine(*makers: WindowColumns) -> WindowColumns:
    return lambda w: {n: c for make in makers for n, c in make(w).items()}


PREVIOUS = {"pace_minutes": "pace", "distance": "distance", "average_heart_rate": "heart_rate"}
LAGS = {"pace_minutes": "pace", "average_cadence": "cadence", "average_heart_rate": "hr"}


def _present(sources: Mapping[str, str], df: DataFrame) -> dict[str, str]:
    return {c: s for c, s in sources.items() if c in df.columns}


def add_previous(df: DataFrame, sources: Mapping[str, str] = PREVIOUS, keys: Keys = RUNS, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    return add_row_windows(df, previous_columns(_present(sources, df)), 1, 0, keys, policy)


def add_differences(df: DataFrame, sources: Mapping[str, str] = PREVIOUS) -> DataFrame:
    """``<stem>_diff`` against the previous run; needs the ``_previous`` columns."""
    return df.withColumns(
        {
            f"{stem}_diff": F.col(q(c)) - F.col(f"{stem}_previous")
            for c, stem in sources.items()
            if c in df.columns and f"{stem}_previous" in df.columns
        }
    )


def add_lags(df: DataFrame, lags: int = 4, sources: Mapping[str, str] = LAGS, keys: Keys = RUNS, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    return add_row_windows(df, lag_columns(_present(sources, df), lags), lags, 0, keys, policy)


def add_days_since_last(df: DataFrame, keys: Keys = RUNS, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    return add_row_windows(df, gap_columns(keys.time), 1, 0, keys, policy)


# ---------------------------------------------------------------- trailing windows


def _over(upto: str, keys: Keys) -> str:
    """Everything of the entity up to a point in time. Such frames only ever grow, so a task's work is
    proportional to its rows, however many a window holds."""
    return (
        f"OVER (PARTITION BY {q(keys.entity)}, {SHARD} ORDER BY {q(keys.time)} "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND {upto})"
    )


@dataclass(frozen=True)
class Trailing:
    """Which trailing features to compute, for every width in days."""

    averages: Mapping[str, str]
    totals: Mapping[str, str]
    run_count: bool = True
    widths: tuple[int, ...] = WIDTHS

    def within(self, df: DataFrame) -> Trailing:
        return replace(self, averages=_present(self.averages, df), totals=_present(self.totals, df))

    @property
    def sources(self) -> list[str]:
        return list(dict.fromkeys([*self.averages, *self.totals]))


TRAILING = Trailing(schema.ROLLING_METRICS, {"distance": "distance"})


def _limb_columns(spec: Trailing, limbs: Sequence[Limbs]) -> dict[str, Column]:
    """``_s<i>_<k>``: limb k of source i."""
    return {
        f"_s{i}_{k}": part
        for i, (c, cut) in enumerate(zip(spec.sources, limbs))
        for k, part in enumerate(cut.split(exact_sums.finite(c)))
    }


def _features_of(spec: Trailing, limbs: Sequence[Limbs], limb: Callable[[int, int, int], Column], count: Callable[[int, int], Column], runs: Callable[[int], Column]) -> dict[str, Column]:
    """The trailing columns from the sums of limbs, the counts of values and the counts of runs per width."""
    out: dict[str, Column] = {}
    place = {c: i for i, c in enumerate(spec.sources)}
    for days in spec.widths:

        def total(c: str) -> tuple[Column, Column]:
            i = place[c]
            return limbs[i].join([limb(i, k, days) for k in range(limbs[i].count)]), count(i, days)

        for c, stem in spec.averages.items():
            value, n = total(c)
            out[f"{days}d_avg_{stem}"] = F.when(n > 0, value / n)
        for c, stem in spec.totals.items():
            value, n = total(c)
            out[f"{days}d_total_{stem}"] = F.when(n > 0, value)
        if spec.run_count:
            out[f"{days}d_run_count"] = runs(days).cast("bigint")
    return out


def _plain_trailing(df: DataFrame, spec: Trailing, limbs: Sequence[Limbs], keys: Keys) -> DataFrame:
    """(t - days, t] as everything up to t less everything up to t - days, both exact."""
    parts = _limb_columns(spec, limbs)
    upto = {0: "CURRENT ROW"} | {days: f"INTERVAL '{days}' DAY PRECEDING" for days in spec.widths}
    sums = []
    for days, end in upto.items():
        over = _over(end, keys)
        sums += [f"coalesce(sum({n}) {over}, 0) AS {n}_{days}" for n in parts]
        sums += [f"count(_s{i}_0) {over} AS _n{i}_{days}" for i in range(len(limbs))]
        if spec.run_count:
            sums.append(f"count(1) {over} AS _runs_{days}")
    summed = df.withColumns(parts).selectExpr(*map(q, df.columns), *sums)

    def within(name: str, days: int) -> Column:
        return F.col(f"{name}_0") - F.col(f"{name}_{days}")

    found = _features_of(
        spec,
        limbs,
        lambda i, k, days: within(f"_s{i}_{k}", days),
        lambda i, days: within(f"_n{i}", days),
        lambda days: within("_runs", days),
    )
    return summed.select(*map(q, df.columns), *[skew.dated_only(c, keys.entity, keys.time).alias(n) for n, c in found.items()])


def _chunked_trailing(df: DataFrame, spec: Trailing, limbs: Sequence[Limbs], keys: Keys, rows: int, policy: SplitPolicy) -> DataFrame:
    """Trailing windows as running sums over chunks, in O(n log n) whatever the window holds.

    Activities are first summed per instant, which also removes ties. Every instant then enters
    the running sums at its own time and leaves them ``days`` later, so the sums at any instant
    cover exactly the left-open window. Chunk totals carry the sums across chunk borders. The sums are
    those of limbs, as in the plain plan.
    """
    at, entity = "_at", keys.entity
    parts = _limb_columns(spec, limbs)
    instants = (
        df.select(entity, F.col(q(keys.time)).alias(at), *[c.alias(n) for n, c in parts.items()])
        .groupBy(entity, at)
        .agg(
            F.count(F.lit(1)).alias("_runs"),
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts],
            *[F.count(f"_s{i}_0").alias(f"_n{i}") for i in range(len(limbs))],
        )
    )
    measures = ["_runs", *parts, *[f"_n{i}" for i in range(len(limbs))]]

    moves = [F.struct(F.col(at).alias("at"), F.lit(0).alias("leaves"))]
    for days in spec.widths:
        later = F.col(at) + F.expr(f"INTERVAL '{days}' DAY")
        moves.append(F.struct(later.alias("at"), F.lit(days).alias("leaves")))
    moved = instants.withColumn("_move", F.explode(F.array(*moves)))
    changes = [
        F.when(F.col("_move.leaves") == 0, F.col(m))
        .when(F.col("_move.leaves") == days, -F.col(m))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias(f"{m}_{days}")
        for days in spec.widths
        for m in measures
    ]
    events = moved.select(entity, F.col("_move.at").alias(at), (F.col("_move.leaves") == 0).alias("_enters"), *changes)
    chunks = skew.range_chunks(events, [entity, at], rows * (1 + len(spec.widths)), policy, "trailing")

    names = [f"{m}_{days}" for days in spec.widths for m in measures]
    before = Window.partitionBy(entity).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.groupBy(entity, CHUNK)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            entity, CHUNK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_in") for n in names]
        )
    )
    # Instants equal in time are peers of a range frame, so a leaving instant counts as gone for
    # activities at that very moment.
    so_far = (
        Window.partitionBy(entity, CHUNK)
        .orderBy(at)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        chunks.join(carried, [entity, CHUNK])
        .withColumns({f"{n}_out": F.sum(n).over(so_far) + F.col(f"{n}_in") for n in names})
        .filter("_enters")
    )
    found = _features_of(
        spec,
        limbs,
        lambda i, k, days: F.col(f"_s{i}_{k}_{days}_out"),
        lambda i, days: F.col(f"_n{i}_{days}_out"),
        lambda days: F.col(f"_runs_{days}_out"),
    )
    per_instant = running.select(entity, F.col(at).alias(keys.time), *[c.alias(n) for n, c in found.items()])
    # One row per (entity, instant) on this side; a hot instant is split by the skew join handling.
    return df.join(per_instant, [entity, keys.time], "left")


@dataclass(frozen=True)
class Sized:
    """What one aggregate over a table tells: rows per entity, limbs of its sums, the rows of the largest
    entity, and how many rows lack an entity or time where the size table counts them (``_rest``)."""

    sizes: DataFrame | None
    limbs: list[Limbs]
    most: int | None
    rest: int = 0


def size_measures(spec: Trailing) -> list[Column]:
    return exact_sums.magnitudes(spec.sources)


def sized(sizes: DataFrame, spec: Trailing) -> Sized:
    """Totals of a table that holds ``_n`` and :func:`size_measures` per entity."""
    rest = F.sum("_rest") if "_rest" in sizes.columns else F.lit(0)
    row = skew.totals(sizes, rest.alias("_rest"), *exact_sums.merged(spec.sources))
    return Sized(sizes, exact_sums.plan(row, row["_rows"] or 0, spec.sources), row["_most"] or 0, row["_rest"] or 0)


def _measure(df: DataFrame, spec: Trailing, keys: Keys, policy: SplitPolicy) -> Sized:
    if policy.max_rows is None:
        return Sized(None, exact_sums.plan_for(df, spec.sources), None)
    return sized(skew.entity_sizes(df, keys.entity, keys.time, *size_measures(spec)), spec)


def add_trailing(df: DataFrame, spec: Trailing = TRAILING, keys: Keys = RUNS, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Trailing averages, totals and run counts; nulls are skipped, one value is enough.

    Sums are exact and rounded once, whatever the size of the values or of the runner. NaN and
    infinities count as missing.
    """
    spec = spec.within(df)
    known = _measure(df, spec, keys, policy)
    parts = skew.split_oversized(df, keys.entity, keys.time, policy, known.sizes, known.most)
    sharded = skew.with_shard(parts.ordinary, keys.entity, keys.time, keys.tie)
    # dealt out before the limbs are cut, so that they are not shuffled
    sharded = sharded.repartition(F.col(q(keys.entity)), F.col(SHARD))
    out = _plain_trailing(sharded, spec, known.limbs, keys).drop(SHARD)
    if parts.oversized is not None:
        out = out.unionByName(
            _chunked_trailing(parts.oversized, spec, known.limbs, keys, parts.oversized_rows, policy)
        )
    return out


def add_history(
    df: DataFrame,
    make: WindowColumns,
    back: int,
    spec: Trailing = TRAILING,
    keys: Keys = RUNS,
    policy: SplitPolicy = DEFAULT_POLICY,
    known: Sized | None = None,
) -> DataFrame:
    """Row windows and trailing windows together.

    Row windows come first: their sort order (entity, time, tie) also serves the trailing frames,
    so ordinary runners need one exchange and one sort in all. ``known`` may hold the measures of the
    table or of one that contains it.
    """
    spec = spec.within(df)
    known = _measure(df, spec, keys, policy) if known is None else known
    parts = skew.split_oversized(df, keys.entity, keys.time, policy, known.sizes, known.most)
    sharded = skew.with_shard(parts.ordinary, keys.entity, keys.time, keys.tie)
    out = _plain_trailing(_plain_rows(sharded, make, keys), spec, known.limbs, keys).drop(SHARD)
    if parts.oversized is not None:
        chunks = _chunk_history(parts, keys, policy)
        rows = stage(_chunked_rows(chunks, make, back, 0, keys).drop(CHUNK), "lagged")
        out = out.unionByName(_chunked_trailing(rows, spec, known.limbs, keys, parts.oversized_rows, policy))
    return out


# ---------------------------------------------------------------- fills


def fill_in_order(
    df: DataFrame,
    column: str,
    backward: bool = False,
    keys: Keys = RUNS,
    policy: SplitPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Forward-fill nulls along each entity's history, then optionally backward.

    The backward pass runs as a forward pass over the reversed order; a frame reaching to the end
    of the partition would be quadratic.
    """
    parts = skew.split_oversized(df, keys.entity, keys.time, policy)
    sharded = skew.with_shard(parts.ordinary, keys.entity, keys.time, keys.tie)
    out = _fill_within(sharded, column, backward, keys, SHARD).drop(SHARD)
    if parts.oversized is not None:
        chunks = _chunk_history(parts, keys, policy)
        out = out.unionByName(_chunked_fill(chunks, column, backward, keys).drop(CHUNK))
    return out


def _last_known(column: str, keys: Keys, piece: str, reverse: bool = False) -> Column:
    time, tie = F.col(q(keys.time)), F.col(q(keys.tie))
    order = (time.desc(), tie.desc()) if reverse else (time, tie)
    w = Window.partitionBy(keys.entity, piece).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(frame)


def _fill_within(df: DataFrame, column: str, backward: bool, keys: Keys, piece: str) -> DataFrame:
    value = F.col(q(column))
    filled = df.withColumn("_forward", _last_known(column, keys, piece))
    choices = [value, F.col("_forward")]
    if backward:
        filled = filled.withColumn("_backward", _last_known(column, keys, piece, reverse=True))
        choices.append(F.col("_backward"))
    known = skew.dated_only(F.coalesce(*choices), keys.entity, keys.time)
    return filled.withColumn(column, F.coalesce(value, known)).drop("_forward", "_backward")


def _chunked_fill(df: DataFrame, column: str, backward: bool, keys: Keys) -> DataFrame:
    """Per-chunk fills; the nearest known value of earlier (later) chunks fills what is left."""
    position = F.struct(keys.time, keys.tie)
    known = F.col(q(column)).isNotNull()
    ends = df.groupBy(keys.entity, CHUNK).agg(
        F.max_by(F.when(known, F.col(q(column))), F.when(known, position)).alias("_tail"),
        F.min_by(F.when(known, F.col(q(column))), F.when(known, position)).alias("_head"),
    )
    earlier = Window.partitionBy(keys.entity).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(keys.entity).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        keys.entity,
        CHUNK,
        F.last("_tail", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_head", ignorenulls=True).over(later).alias("_after"),
    )
    # Forward fill of the whole history comes before any backward fill.
    joined = df.join(carried, [keys.entity, CHUNK], "left")
    forward = _fill_within(joined, column, False, keys, CHUNK).withColumn(
        column, F.coalesce(F.col(q(column)), F.col("_before"))
    )
    if backward:
        # what is still null has no earlier value at all, so only later ones can follow
        forward = _fill_within(forward, column, True, keys, CHUNK).withColumn(
            column, F.coalesce(F.col(q(column)), F.col("_after"))
        )
    return forward.drop("_before", "_after")


# ---------------------------------------------------------------- sequences


def sequences(
    df: DataFrame,
    window_size: int = 4,
    include_targets: bool = False,
    min_length: int = 0,
    features: Sequence[str] = tuple(schema.SEQUENCE_FEATURES),
    keys: Keys = RUNS,
    policy: SplitPolicy = DEFAULT_POLICY,
    required: bool = False,
) -> DataFrame:
    """Sliding windows of ``window_size`` consecutive runs, one row each.

    A window is only emitted when a further run follows it; that run is the optional target.
    Missing values take the median of their column. With ``required`` a table in which no runner has enough
    runs is an error.
    """
    used = [c for c in features if c in df.columns]
    if len(used) < 2:
        raise ValueError("not enough feature columns for sequences")
    df = df.filter(F.col(q(keys.entity)).isNotNull() & F.col(q(keys.time)).isNotNull())
    if required:
        most = skew.totals(skew.entity_sizes(df, keys.entity, keys.time))["_most"] or 0
        if most < max(window_size + 1, min_length):
            raise ValueError("no runner has enough runs for a sequence")
    gaps = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(f"_{i}") for i, c in enumerate(used)]).first()
    medians = quantiles.exact_medians(df, [c for c, n in zip(used, gaps) if n])
    step = F.array(
        *[F.coalesce(F.col(q(c)).cast("double"), F.lit(medians.get(c)).cast("double")) for c in used]
    )
    base = df.select(keys.entity, keys.time, keys.tie, step.alias("_step"))

    def make(w: WindowSpec) -> dict[str, Column]:
        # offsets are cheaper than collecting a list per row, and all steps exist where a target does
        steps = [F.col("_step"), *[F.lead("_step", k).over(w) for k in range(1, window_size)]]
        return {"window": F.array(*steps), "target": F.lead("_step", window_size).over(w)}

    if min_length > window_size + 1:
        sizes = base.groupBy(keys.entity).agg(F.count(F.lit(1)).alias("_n"))
        enough = sizes.filter(F.col("_n") >= min_length).select(keys.entity)
        base = base.join(enough, keys.entity, "left_semi")
    found = add_row_windows(base, make, 0, window_size, keys, policy).filter("target IS NOT NULL")
    columns = [keys.entity, F.col(keys.time).alias("start_date"), keys.tie, "window"]
    return found.select(*columns, *(["target"] if include_targets else []))
