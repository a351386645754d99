"""Attribution statistics: importance, period means, trend lines, correlations.

Input is the long table (activity_id, date, feature, value, shap). Everything here is a groupBy
over few distinct keys, combined before the shuffle, so no feature or period can overload a task.
Windows only run over the aggregated (feature, period) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.functions import calendar

# --- fixed values: thresholds and labels of the trend report ---
HIGH_R2, MEDIUM_R2 = 0.5, 0.2
STRONG_CORR, MODERATE_CORR = 0.7, 0.3
TREND_LABELS = {
    "faster_falling": "IMPROVING (having greater positive impact)",
    "faster_rising": "DIMINISHING (having less positive impact)",
    "slower_falling": "IMPROVING (having less negative impact)",
    "slower_rising": "WORSENING (having greater negative impact)",
}


def feature_summary(df: DataFrame) -> DataFrame:
    """Per feature: mean, sample standard deviation, range and count of its values."""
    return df.groupBy("feature").agg(
        F.avg("value").alias("avg_value"),
        F.stddev_samp("value").alias("std_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("value").alias("num_runs"),
    )


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("period", calendar.year_month(F.col("date")))


def with_week(df: DataFrame) -> DataFrame:
    """``period`` runs forward in time: the oldest week has the lowest number."""
    from paceforge.operators import selection

    binned = selection.add_week_bins(df).filter("week_bin IS NOT NULL")
    return binned.withColumn("period", -F.col("week_bin"))


def period_means(df: DataFrame) -> DataFrame:
    """Mean value and mean attribution per (period, feature)."""
    return df.groupBy("period", "feature").agg(
        F.avg("value").alias("avg_value"), F.avg("shap").alias("avg_shap"), F.count(F.lit(1)).alias("runs")
    )


def value_trend_line(periods: DataFrame) -> DataFrame:
    """Line through (mean value, mean attribution) of the periods, per feature."""
    return periods.groupBy("feature").agg(
        F.regr_slope("avg_shap", "avg_value").alias("slope"),
        F.regr_intercept("avg_shap", "avg_value").alias("intercept"),
    )


def confidence(r2: Column) -> Column:
    return F.when(r2 > HIGH_R2, "High").when(r2 > MEDIUM_R2, "Medium").otherwise("Low")


def direction(mean: Column, slope: Column) -> Column:
    return (
        F.when((mean < 0) & (slope < 0), TREND_LABELS["faster_falling"])
        .when(mean < 0, TREND_LABELS["faster_rising"])
        .when(slope < 0, TREND_LABELS["slower_falling"])
        .otherwise(TREND_LABELS["slower_rising"])
    )


def shap_trend(periods: DataFrame) -> DataFrame:
    """Linear trend of the period means over the period ordinal; two periods are needed."""
    order = Window.partitionBy("feature").orderBy("period")
    numbered = periods.withColumn("ordinal", (F.row_number().over(order) - 1).cast("double"))
    fitted = numbered.groupBy("feature").agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("avg_shap").alias("mean_shap"),
        F.regr_slope("avg_shap", "ordinal").alias("slope"),
        F.regr_intercept("avg_shap", "ordinal").alias("intercept"),
        F.regr_r2("avg_shap", "ordinal").alias("r2"),
    )
    return fitted.filter("periods >= 2").select(
        "*",
        confidence(F.col("r2")).alias("confidence"),
        direction(F.col("mean_shap"), F.col("slope")).alias("trend"),
    )


def trend_change(periods: DataFrame) -> DataFrame:
    """First and last period of each feature and the percentage change between them."""
    ends = periods.groupBy("feature").agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.min_by("avg_shap", "period").alias("first_shap"),
        F.max_by("avg_shap", "period").alias("last_shap"),
        F.avg("avg_shap").alias("mean_shap"),
        F.count(F.lit(1)).alias("periods"),
    )
    change = F.col("last_shap") - F.col("first_shap")
    base = F.nullif(F.abs("first_shap"), F.lit(0.0))
    return ends.withColumn("pct_change", F.when(F.col("periods") >= 2, change / base * 100))


def value_correlation(periods: DataFrame) -> DataFrame:
    """Pearson correlation of period means of value and attribution, with its wording."""
    found = periods.groupBy("feature").agg(
        F.corr("avg_value", "avg_shap").alias("corr"), F.count(F.lit(1)).alias("periods")
    )
    size = F.abs("corr")
    strength = (
        F.when(size > STRONG_CORR, "strong").when(size > MODERATE_CORR, "moderate").otherwise("weak")
    )
    sign = F.when(F.col("corr") > 0, "positive").otherwise("negative")
    effect = F.when(F.col("corr") > MODERATE_CORR, "slows more as it increases").when(
        F.col("corr") < -MODERATE_CORR, "helps more as it increases"
    )
    return found.filter("periods > 1").select(
        "feature",
        "corr",
        strength.alias("strength"),
        sign.alias("direction"),
        effect.alias("effect"),
    )


def analysis_bounds(df: DataFrame) -> DataFrame:
    """First and last date, number of runs and of months covered."""
    runs = df.groupBy("activity_id").agg(F.min("date").alias("date"))
    return runs.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct(calendar.year_month(F.col("date"))).alias("months"),
    )
