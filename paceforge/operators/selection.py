"""Picking rows and features: latest runs, trailing periods, top-n and chosen features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.functions import calendar
from paceforge.schema import q


def latest_date(df: DataFrame, date: str = "date") -> Column:
    """Scalar subquery with the last date of the table; no join, pushed to the scan as a filter."""
    return df.select(F.max(q(date))).scalar()


def has_dates(df: DataFrame, date: str = "date") -> bool:
    """Whether any row has a date; stops at the first one."""
    return date in df.columns and bool(df.filter(F.col(q(date)).isNotNull()).limit(1).count())


def latest_run(df: DataFrame, date: str = "date", tie: str = "activity_id") -> DataFrame:
    """All rows at the last date; of a table without dates the first row by ``tie``."""
    if not has_dates(df, date):
        return df.orderBy(q(tie)).limit(1) if tie in df.columns else df.limit(1)
    return df.filter(F.col(q(date)) == latest_date(df, date))


def latest_run_per_runner(
    df: DataFrame, entity: str = "runner_id", date: str = "date", tie: str = "activity_id"
) -> DataFrame:
    """One row per runner: the last by date, then by activity. Combined before the shuffle."""
    row = F.struct(*[F.col(q(c)) for c in df.columns])
    latest = df.filter(F.col(q(date)).isNotNull()).groupBy(entity).agg(
        F.max_by(row, F.struct(q(date), q(tie))).alias("_row")
    )
    return latest.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def trailing_months(df: DataFrame, months: int = 3, date: str = "date") -> DataFrame:
    """Rows from ``months`` before the last date on; month ends are clamped, time of day kept.

    A table without any date has no period to cut, so all its rows stay; that is found out first, as a
    filter that covers both cases could not be pushed to the scan.
    """
    if not has_dates(df, date):
        return df
    cutoff = df.select(F.max(q(date)) - F.make_ym_interval(F.lit(0), F.lit(months))).scalar()
    return df.filter(F.col(q(date)) >= cutoff)


def add_week_bins(df: DataFrame, date: str = "date") -> DataFrame:
    """``days_ago`` before the last date, and ``week_bin`` 1 (latest week), 2, ..."""
    ago = calendar.elapsed_days(F.col(q(date)), latest_date(df, date))
    with_days = df.withColumn("days_ago", ago)
    oldest = df.select(F.min(q(date))).scalar()
    max_days = calendar.elapsed_days(oldest, latest_date(df, date))
    return with_days.withColumn("week_bin", calendar.week_bin(F.col("days_ago"), max_days))


def feature_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute and mean attribution per feature."""
    return attributions.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("importance"), F.avg("shap").alias("mean_shap")
    )


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def choose_features(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of the features named by the user; unknown names are left out."""
    return attributions.filter(F.col("feature").isin(list(features)))


def unknown_features(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """The named features the table does not have."""
    spark = attributions.sparkSession
    asked = spark.createDataFrame([(f,) for f in features], "feature string")
    return asked.join(attributions.select("feature").distinct(), "feature", "left_anti")
