"""Missing values: ordered fills, fitted constants, null profile.

``fit_*`` functions read the data once and return plain values; ``fill`` applies them. Fitting on
the training part only keeps test rows out of the constants.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceforge import schema
from paceforge.operators import quantiles, timeline
from paceforge.operators.skew import DEFAULT_POLICY, SplitPolicy
from paceforge.schema import q
from paceforge.session import stage


def fill_heart_rate(
    df: DataFrame, column: str = "average_heart_rate", policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Forward, then backward along each runner, then the median of the filled column.

    The median is found on the columns the fills need, so the wide rows are neither copied nor read for it.
    """
    keys = timeline.RUNS
    narrow = df.select(*map(q, dict.fromkeys([keys.entity, keys.time, keys.tie, column])))
    known = stage(timeline.fill_in_order(narrow, column, backward=True, policy=policy).select(q(column)), "filled")
    medians = quantiles.exact_medians(known, [column])
    return fill(timeline.fill_in_order(df, column, backward=True, policy=policy), medians)


def fit_means(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float | None]:
    columns = schema.numeric_columns(df) if columns is None else list(columns)
    if not columns:
        return {}
    row = df.agg(*[F.avg(q(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def fit_medians(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float | None]:
    return quantiles.exact_medians(df, schema.numeric_columns(df) if columns is None else columns)


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties, ``''`` when there is none."""
    columns = list(columns)
    if not columns:
        return {}
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(q(c)).cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(pairs.alias("p"))
        .filter("p.value IS NOT NULL")
        .groupBy("p.name", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # smallest struct = highest count, then smallest value; combined before the shuffle
    best = counts.groupBy("name").agg(F.min(F.struct(-F.col("n"), "value")).alias("best"))
    found = {r["name"]: r["value"] for r in best.select("name", "best.value").collect()}
    return {c: found.get(c, "") for c in columns}


def fill(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = {}
    for name, value in constants.items():
        if value is None or name not in types:
            continue
        current = F.col(q(name))
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            current = F.when(~F.isnan(current), current)
        elif isinstance(types[name], T.NumericType):
            current = current.cast("double")
        changes[name] = F.coalesce(current, F.lit(value))
    return df.withColumns(changes)


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fill(df, fit_means(df, columns))


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fill(df, fit_medians(df, columns))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill(df, fit_modes(df, columns))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share per column, one pass."""
    columns = list(df.columns if columns is None else columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(q(c)).isNull()).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    entries = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_count")) for i, c in enumerate(columns)])
    )
    return counts.select("_rows", entries.alias("e")).select(
        "e.column_name",
        "e.null_count",
        (F.col("e.null_count") / F.nullif(F.col("_rows"), F.lit(0))).alias("null_ratio"),
    )


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=None if columns is None else list(columns))
