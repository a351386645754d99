"""The activity flow: clean -> features -> tabular rows and sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceforge import schema
from paceforge.functions import calendar, pace
from paceforge.operators import cleaning, paces, timeline
from paceforge.operators.skew import DEFAULT_POLICY, SplitPolicy
from paceforge.schema import q

SOURCE_ROW = "source_row"

# Columns holding minutes that the output stages show as M'SS" or M:SS text.
PRIME_COLUMNS = ["7d_avg_pace", "30d_avg_pace", "pace_previous", "pace_diff"]


def with_pace(df: DataFrame) -> DataFrame:
    """``pace_minutes``: the recorded pace, else moving time over distance, else from speed."""
    candidates = []
    if "pace" in df.columns:
        text = dict(df.dtypes)["pace"] == "string"
        candidates.append(pace.parse(F.col("pace")) if text else pace.finite(F.col("pace").cast("double")))
    if {"moving_time", "distance"} <= set(df.columns):
        candidates.append(pace.from_time(F.col("moving_time"), F.col("distance")))
    elif "average_speed" in df.columns:
        candidates.append(pace.from_speed(F.col("average_speed")))
    if not candidates:
        return df
    return df.withColumn("pace_minutes", F.coalesce(*candidates))


def _prepared(df: DataFrame) -> DataFrame:
    """Without stale window columns, with paces, cadence in steps of both feet."""
    stale = [c for c in df.columns if c.startswith(("7d_", "30d_"))]
    df = with_pace(df.drop(*stale))
    if "average_cadence" in df.columns:
        # exports count the steps of one foot
        df = df.withColumn("average_cadence", F.col("average_cadence") * 2)
    return df


def features(df: DataFrame, lags: int = 0, policy: SplitPolicy = DEFAULT_POLICY, tie: str = "activity_id") -> DataFrame:
    """Cleaned activities with all derived features, paces as minutes.

    Previous-run columns, lags, gaps and both trailing windows share one exchange per runner.
    ``tie`` orders activities of one runner that share a timestamp.
    """
    return _histories(_prepared(df), lags, policy, tie)


def _histories(
    df: DataFrame, lags: int, policy: SplitPolicy, tie: str, known: timeline.Sized | None = None
) -> DataFrame:
    present = lambda names: {c: s for c, s in names.items() if c in df.columns}
    windows = [timeline.previous_columns(present(timeline.PREVIOUS)), timeline.gap_columns("date")]
    if lags:
        windows.append(timeline.lag_columns(present(timeline.LAGS), lags))
    keys = timeline.Keys(tie=tie)
    df = timeline.add_history(
        sortable(df, tie), timeline.combine(*windows), max(1, lags), keys=keys, policy=policy, known=known
    )
    df = restored(df, tie)
    df = timeline.add_differences(df)
    d = F.col("date")
    return df.withColumns(
        {
            "week_number": calendar.week_number(d),
            "day_of_week": calendar.day_of_week(d),
            "month": F.month(d),
            "is_weekend": calendar.is_weekend(d),
        }
    )


def sortable(df: DataFrame, name: str) -> DataFrame:
    """Text ids so that they sort as numbers (9 before 10), other text after all numbers."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    text = F.col(q(name))
    size = F.lpad(F.length(text).cast("string"), 10, "0")
    return df.withColumn(name, F.concat(F.when(text.rlike("^[0-9]+$"), size).otherwise("~" * 10), text))


def restored(out: DataFrame, name: str) -> DataFrame:
    """Undo :func:`sortable`."""
    if not isinstance(out.schema[name].dataType, T.StringType):
        return out
    return out.withColumn(name, F.substring(q(name), F.lit(11), F.length(q(name))))


def render_paces(df: DataFrame) -> DataFrame:
    """Text forms of the pace columns; ``pace_minutes`` stays for later stages."""
    if "pace_minutes" in df.columns:
        df = df.withColumn("pace", F.col("pace_minutes"))
    prime = [c for c in ["pace", *PRIME_COLUMNS] if c in df.columns]
    return paces.render(df, prime, [c for c in df.columns if c.startswith("pace_t-")])


def _numbered(df: DataFrame, lags: int, policy: SplitPolicy, ordinal: str) -> DataFrame:
    """Features with dense runner ids and pace text.

    The ids join comes before the windows: whether it is broadcast or by key, the rows are then
    exchanged once, as the windows accept the partitioning of the join. Rows without a date or
    runner have no history; they go a separate way so that many of them cannot pile up on one key.
    """
    df = _prepared(sortable(df, ordinal))
    spec = timeline.TRAILING.within(df)
    # one pass per runner, and one aggregate over its result, tell all that the plans depend on
    runners = cleaning.runner_table(df, ordinal, timeline.size_measures(spec))
    known = timeline.sized(runners, spec)
    dated = F.col("date").isNotNull() & F.col("runner_id").isNotNull()

    def numbered(rows: DataFrame, part: SplitPolicy) -> DataFrame:
        named = cleaning.add_dense_ids(rows, runners)
        return render_paces(_histories(named, lags, part, ordinal, known))

    out = numbered(df.filter(dated), policy)
    if known.rest:
        out = out.unionByName(numbered(df.filter(~dated), replace(policy, max_rows=None)))
    return restored(cleaning.use_dense_ids(out), ordinal)


def feature_stage(
    df: DataFrame, policy: SplitPolicy = DEFAULT_POLICY, ordinal: str = "activity_id"
) -> DataFrame:
    """Feature rows as stored: dense runner ids, pace text, grouped columns.

    ``ordinal`` is a column in export order: it numbers the runners and breaks ties. Text ids of digits
    count as numbers.
    """
    out = _numbered(df, 0, policy, ordinal)
    return out.select(*map(q, schema.order_features(out.columns)))


def tabular(
    df: DataFrame, lags: int = 4, policy: SplitPolicy = DEFAULT_POLICY, ordinal: str = "activity_id"
) -> DataFrame:
    """Cleaned activities to training rows: features, lags, dense runner ids, fixed column order."""
    out = _numbered(df, lags, policy, ordinal)
    return out.select(*map(q, schema.order_tabular(out.columns)))


def sequence_stage(
    df: DataFrame,
    window_size: int = 4,
    include_targets: bool = False,
    policy: SplitPolicy = DEFAULT_POLICY,
    tie: str = "activity_id",
) -> DataFrame:
    """Cleaned activities to sliding sequences."""
    df = with_pace(df)
    if "average_cadence" in df.columns:
        df = df.withColumn("average_cadence", F.col("average_cadence") * 2)
    keys = timeline.Keys(tie=tie)
    out = timeline.sequences(sortable(df, tie), window_size, include_targets, keys=keys, policy=policy)
    return restored(out, tie)


def run(raw: DataFrame, lags: int = 4, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """Raw export to training rows; the runner table is written on the way, the rest is lazy."""
    return tabular(cleaning.clean(raw), lags, policy)


def write_stages(
    raw: DataFrame, folder: str, lags: int = 4, window_size: int = 4, policy: SplitPolicy = DEFAULT_POLICY
) -> dict[str, int]:
    """Write cleaned, feature, tabular and sequence tables; return their row counts.

    The cleaned table is written first, so the export is parsed once; the others come from it.
    It also pins the row order of the export, which numbers the runners and breaks ties. Counts
    come from the writes themselves.
    """
    spark = raw.sparkSession
    seen = Observation("raw")
    counts: dict[str, int] = {}
    numbered = raw.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn(
        SOURCE_ROW, F.monotonically_increasing_id()
    )
    cleaned = cleaning.clean(numbered, keep=[SOURCE_ROW])
    counts["cleaned"] = _write_counted(cleaned, f"{folder}/cleaned")
    counts["raw"] = seen.get["rows"]
    if counts["cleaned"] == 0:
        raise ValueError("no valid activities in the export")
    cleaned = spark.read.parquet(f"{folder}/cleaned")
    # histories are worked out once: feature rows are the training rows without their lags
    wide = _numbered(cleaned, lags, policy, SOURCE_ROW).drop(SOURCE_ROW)
    counts["tabular"] = _write_counted(wide.select(*map(q, schema.order_tabular(wide.columns))), f"{folder}/tabular")
    lagged = {f"{stem}_t-{k}" for k in range(1, lags + 1) for stem in timeline.LAGS.values()}
    names = schema.order_features([c for c in wide.columns if c not in lagged])
    stages = {
        "features": spark.read.schema(wide.schema).parquet(f"{folder}/tabular").select(*map(q, names)),
        "sequences": sequence_stage(cleaned, window_size, policy=policy, tie=SOURCE_ROW).drop(SOURCE_ROW),
    }
    for name, df in stages.items():
        counts[name] = _write_counted(df, f"{folder}/{name}")
    return counts


def _write_counted(df: DataFrame, path: str) -> int:
    written = Observation(path.rsplit("/", 1)[-1])
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return written.get["rows"]
