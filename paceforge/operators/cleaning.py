"""Header normalisation, typing, data-quality rules and runner ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceforge import schema
from paceforge.functions import pace
from paceforge.operators import numbering
from paceforge.session import stage

# --- fixed values: bounds of the row rules (both ends excluded) ---
MAX_DISTANCE = 100
MIN_HEART_RATE = 30
MAX_HEART_RATE = 250


def normalise_headers(df: DataFrame) -> DataFrame:
    names = schema.unique_names(schema.normalise_name(c) for c in df.columns)
    return df.toDF(*names)


def standardise_columns(df: DataFrame) -> DataFrame:
    """Normalised headers, then aliases renamed to canonical names.

    When two source columns would end up with one name, the alias that comes first wins and the
    other column is dropped.
    """
    df = normalise_headers(df)
    mapping = schema.alias_mapping(df.columns)
    picked = {canonical: source for source, canonical in mapping.items()}
    columns = [
        F.col(schema.q(c)).alias(mapping.get(c, c))
        for c in df.columns
        if c in mapping or c not in picked
    ]
    return df.select(*columns)


def select_relevant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Known columns in canonical order, then the ones in ``keep``."""
    return df.select(*[c for c in [*schema.CANONICAL_COLUMNS, *keep] if c in df.columns])


def parse_dates(df: DataFrame, column: str = "date", strict: bool = False) -> DataFrame:
    """Text to a zone-less timestamp; unreadable text becomes null, or an error if ``strict``."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.trim(F.col(column))
    # --- fixed values: accepted text layouts besides ISO ---
    layouts = [
        "MMM d, yyyy, h:mm:ss a", "MMM d, yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    ]
    iso = text.try_cast("timestamp_ntz")
    # Times parsed under a layout carry the session zone; going through text drops it again.
    others = [
        F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in layouts
    ]
    found = F.coalesce(iso, *others)
    if strict:
        unreadable = F.raise_error(F.concat(F.lit("unreadable date: "), text)).cast("timestamp_ntz")
        found = F.when(found.isNotNull() | text.isNull(), found).otherwise(unreadable)
    return df.withColumn(column, found)


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text to finite doubles, null where unreadable. Pace keeps its textual forms readable."""
    wanted = schema.NUMERIC_COLUMNS if columns is None else list(columns)
    changes: dict[str, Column] = {}
    for name in wanted:
        if name not in df.columns:
            continue
        textual = isinstance(df.schema[name].dataType, T.StringType)
        if name == "pace" and textual:
            changes[name] = pace.parse(F.col(name))
        else:
            changes[name] = pace.number(F.col(name)) if textual else pace.finite(F.col(name).cast("double"))
    return df.withColumns(changes)


def keep_runs(df: DataFrame) -> DataFrame:
    """Only activities of type run, any case; rows without a type go. No column, no filter."""
    if "activity_type" not in df.columns:
        return df
    return df.filter(F.lower("activity_type") == "run")


def row_rules(columns: Sequence[str], keep_missing_hr: bool = False) -> dict[str, Column]:
    """Named pass conditions of the row rules that apply to these columns."""
    rules: dict[str, Column] = {}
    if "distance" in columns:
        rules["distance"] = (F.col("distance") > 0) & (F.col("distance") < MAX_DISTANCE)
    if "elapsed_time" in columns:
        rules["elapsed_time"] = F.col("elapsed_time") > 0
    if "average_heart_rate" in columns:
        hr = F.col("average_heart_rate")
        within = (hr > MIN_HEART_RATE) & (hr < MAX_HEART_RATE)
        rules["average_heart_rate"] = within | hr.isNull() if keep_missing_hr else within
    return rules


def filter_valid(df: DataFrame, keep_missing_hr: bool = False) -> DataFrame:
    for rule in row_rules(df.columns, keep_missing_hr).values():
        df = df.filter(rule)
    return df


def audit(df: DataFrame, keep_missing_hr: bool = False) -> DataFrame:
    """One row of counts per cleaning step, from a single pass.

    Rules are counted in order: a row is charged to the first rule it fails.
    """
    passed = F.lit(True)
    counts: list[Column] = [F.count(F.lit(1)).alias("rows_in")]
    if "activity_type" in df.columns:
        is_run = F.coalesce(F.lower("activity_type") == "run", F.lit(False))
        counts.append(F.count_if(~is_run).alias("rejected_activity_type"))
        passed = is_run
    for name, rule in row_rules(df.columns, keep_missing_hr).items():
        holds = F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed & ~holds).alias(f"rejected_{name}"))
        passed = passed & holds
    counts.append(F.count_if(passed).alias("rows_out"))
    if "runner_id" in df.columns:
        counts.append(F.count_distinct(F.when(passed, F.col("runner_id"))).alias("runners_out"))
    return df.agg(*counts)


def default_runner(df: DataFrame) -> DataFrame:
    """Runner ids as text; a single default runner when the export has none."""
    if "runner_id" in df.columns:
        return df.withColumn("runner_id", F.col("runner_id").cast("string"))
    if "activity_id" in df.columns:
        return df.withColumn("runner_id", F.lit(schema.DEFAULT_RUNNER))
    return df


def runner_table(df: DataFrame, ordinal: str = "activity_id", measures: Sequence[Column] = ()) -> DataFrame:
    """One row per runner: activities with a date (``_n``), without a date or runner (``_rest``), the
    first position (``_first``) and further aggregates.

    Written once; it tells oversized runners, numbers all runners and shows whether any row lacks
    a history, with one pass over two or three columns of the input.
    """
    dated = F.col("date").isNotNull() & F.col("runner_id").isNotNull()
    table = df.groupBy("runner_id").agg(
        F.count_if(dated).alias("_n"), F.count_if(~dated).alias("_rest"), F.min(ordinal).alias("_first"), *measures
    )
    return stage(table, "runners")


DENSE = "_dense"


def add_dense_ids(df: DataFrame, runners: DataFrame) -> DataFrame:
    """Add the dense id of each row's runner as ``_dense``, from a :func:`runner_table`.

    Only the distinct runners are numbered. The join is left to the size-checked choice of the
    engine: a small runner table is broadcast, a large one is joined by key.
    """
    named = runners.filter("runner_id IS NOT NULL").select("runner_id", "_first")
    numbered = numbering.number_rows(named, "_first", "runner_id", "_n")
    text = F.col("_n").cast("string")
    # lpad cuts text that is already longer, so it only applies to one-digit numbers
    label = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return df.join(numbered.select("runner_id", label.alias(DENSE)), "runner_id", "left")


def use_dense_ids(df: DataFrame) -> DataFrame:
    """Put ``_dense`` in the place of ``runner_id``."""
    kept = [c for c in df.columns if c != DENSE]
    return df.select(*[F.col(DENSE).alias(c) if c == "runner_id" else F.col(schema.q(c)) for c in kept])


def dense_runner_ids(df: DataFrame, ordinal: str = "activity_id") -> DataFrame:
    """Replace runner ids by ``01, 02, ...`` in order of first appearance along ``ordinal``."""
    first = df.groupBy("runner_id").agg(F.min(ordinal).alias("_first"))
    order = df.columns
    out = use_dense_ids(add_dense_ids(df, stage(first, "runners")))
    return out.select(*map(schema.q, order))


def clean(df: DataFrame, keep_missing_hr: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Raw export to the cleaned stage.

    By default rows without a heart rate are rejected with the other invalid rows. With
    ``keep_missing_hr`` they stay and are filled (forward, backward, then median). ``keep`` names
    further columns to carry along, such as the source row number.
    """
    from paceforge.operators import imputation

    df = standardise_columns(df).transform(keep_runs)
    schema.require_columns(df)
    df = df.transform(select_relevant, keep).transform(parse_dates).transform(coerce_numeric)
    df = filter_valid(df, keep_missing_hr).transform(default_runner)
    if keep_missing_hr and {"average_heart_rate", "runner_id", "activity_id"} <= set(df.columns):
        df = imputation.fill_heart_rate(df)
    return df.transform(select_relevant, keep)


def filter_valid_runs(df: DataFrame, keep_missing_hr: bool = False) -> DataFrame:
    """Type filter and row rules on already typed columns."""
    return df.transform(keep_runs).transform(filter_valid, keep_missing_hr)
