"""Queries over selections, attribution statistics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceforge import testbed
from paceforge.operators import encoding, reports, selection, trends
from paceforge.plans.querybook import r6, register
from paceforge.testbed import with_ctes

# ------------------------------------------------------------ selections


@register(
    "latest_run",
    with_ctes(
        "SELECT activity_id, runner_id, date, distance FROM order_runs WHERE date = (SELECT max(date) FROM order_runs)",
        "order_runs",
    ),
)
def latest_run(spark, sf):
    df = testbed.order_runs(spark, sf).transform(selection.latest_run)
    return df.select("activity_id", "runner_id", "date", "distance")


@register(
    "latest_run_per_runner",
    with_ctes(
        """SELECT activity_id, runner_id, date, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY runner_id ORDER BY date DESC, activity_id DESC) AS rn FROM order_runs) WHERE rn = 1""",
        "order_runs",
    ),
)
def latest_run_per_runner(spark, sf):
    df = testbed.order_runs(spark, sf).select("activity_id", "runner_id", "date", "distance")
    return selection.latest_run_per_runner(df)


_TRAILING = {
    "recent": "SELECT * FROM {} WHERE date >= (SELECT max(date) FROM {}) - INTERVAL 3 MONTH"
}


def _recent(source: str) -> dict[str, str]:
    return {"recent": _TRAILING["recent"].format(source, source)}


@register(
    "trailing_months",
    with_ctes(
        "SELECT activity_id, runner_id, date, distance FROM recent", "order_runs", extra=_recent("order_runs")
    ),
)
def trailing_months(spark, sf):
    df = selection.trailing_months(testbed.order_runs(spark, sf), 3)
    return df.select("activity_id", "runner_id", "date", "distance")


# ------------------------------------------------------------ statistics


@register(
    "feature_summary",
    with_ctes(
        """SELECT feature, round(avg(value), 6) AS avg_value, round(stddev_samp(value), 6) AS std_value,
          min(value) AS min_value, max(value) AS max_value, count(value) AS num_runs FROM attributions GROUP BY feature""",
        "attributions",
    ),
)
def feature_summary(spark, sf):
    df = trends.feature_summary(testbed.attributions(spark, sf))
    return df.select(
        "feature", r6("avg_value", "avg_value"), r6("std_value", "std_value"), "min_value", "max_value", "num_runs"
    )


_IMPORTANCE = {
    "importance": "SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap FROM attributions GROUP BY feature"
}


def _importance(spark, sf):
    return selection.feature_importance(testbed.attributions(spark, sf))


@register(
    "shap_importance",
    with_ctes(
        "SELECT feature, round(importance, 6) AS importance, round(mean_shap, 6) AS mean_shap FROM importance",
        "attributions",
        extra=_IMPORTANCE,
    ),
)
def shap_importance(spark, sf):
    return _importance(spark, sf).select("feature", r6("importance", "importance"), r6("mean_shap", "mean_shap"))


@register(
    "top_features",
    with_ctes(
        "SELECT feature, round(importance, 6) AS importance FROM importance ORDER BY importance DESC, feature LIMIT 1",
        "attributions",
        extra=_IMPORTANCE,
    ),
)
def top_features(spark, sf):
    return selection.top_features(_importance(spark, sf), 1).select("feature", r6("importance", "importance"))


@register(
    "importance_rank",
    with_ctes(
        "SELECT cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, round(importance, 6) AS importance FROM importance",
        "attributions",
        extra=_IMPORTANCE,
    ),
)
def importance_rank(spark, sf):
    ranked = reports.importance_rank(_importance(spark, sf))
    return ranked.select("rank", "feature", r6("importance", "importance"))


_CHOSEN = ["order_size", "no_such_feature"]


@register(
    "custom_features",
    with_ctes(
        """SELECT feature, count(*) AS runs, round(avg(shap), 6) AS mean_shap, 'used' AS status
          FROM attributions WHERE feature = 'order_size' GROUP BY feature
        UNION ALL SELECT 'no_such_feature', 0, NULL, 'unknown'""",
        "attributions",
    ),
)
def custom_features(spark, sf):
    df = testbed.attributions(spark, sf)
    used = selection.choose_features(df, _CHOSEN).groupBy("feature").agg(
        F.count(F.lit(1)).alias("runs"), r6(F.avg("shap"), "mean_shap")
    )
    unknown = selection.unknown_features(df, _CHOSEN).select(
        "feature", F.lit(0).cast("bigint").alias("runs"), F.lit(None).cast("double").alias("mean_shap")
    )
    return used.withColumn("status", F.lit("used")).unionByName(unknown.withColumn("status", F.lit("unknown")))


# ------------------------------------------------------------ periods and trends

_MONTHS = {
    "months": """SELECT strftime(date, '%Y-%m') AS period, feature, avg(value) AS avg_value, avg(shap) AS avg_shap, count(*) AS runs
      FROM attributions GROUP BY 1, 2""",
}


def _monthly(spark, sf):
    return trends.period_means(trends.with_month(testbed.attributions(spark, sf)))


@register(
    "shap_monthly",
    with_ctes(
        "SELECT period, feature, round(avg_shap, 6) AS avg_shap, runs FROM months", "attributions", extra=_MONTHS
    ),
)
def shap_monthly(spark, sf):
    return _monthly(spark, sf).select("period", "feature", r6("avg_shap", "avg_shap"), "runs")


@register(
    "shap_weekly",
    with_ctes(
        """SELECT cast(-week_bin AS INTEGER) AS period, feature, round(avg(shap), 6) AS avg_shap, count(*) AS runs FROM (
          SELECT *, greatest(1, ceil(floor((epoch_us((SELECT max(date) FROM recent)) - epoch_us(date)) / 86400000000) / 7)) AS week_bin FROM recent)
        WHERE week_bin <= (SELECT least(13, floor(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) / 7) + 1) FROM recent) GROUP BY 1, 2""",
        "attributions",
        extra=_recent("attributions"),
    ),
)
def shap_weekly(spark, sf):
    recent = selection.trailing_months(testbed.attributions(spark, sf), 3)
    df = trends.period_means(trends.with_week(recent))
    return df.select("period", "feature", r6("avg_shap", "avg_shap"), "runs")


@register(
    "value_vs_shap_period",
    with_ctes(
        "SELECT period, feature, round(avg_value, 6) AS avg_value, round(avg_shap, 6) AS avg_shap FROM months",
        "attributions",
        extra=_MONTHS,
    ),
)
def value_vs_shap_period(spark, sf):
    return _monthly(spark, sf).select(
        "period", "feature", r6("avg_value", "avg_value"), r6("avg_shap", "avg_shap")
    )


@register(
    "value_shap_trendline",
    with_ctes(
        """SELECT feature, round(regr_slope(avg_shap, avg_value), 6) AS slope,
          round(regr_intercept(avg_shap, avg_value), 6) AS intercept FROM months GROUP BY feature""",
        "attributions",
        extra=_MONTHS,
    ),
)
def value_shap_trendline(spark, sf):
    df = trends.value_trend_line(_monthly(spark, sf))
    return df.select("feature", r6("slope", "slope"), r6("intercept", "intercept"))


_TREND_SQL = """SELECT feature, count(*) AS periods, avg(avg_shap) AS mean_shap, regr_slope(avg_shap, ordinal) AS slope,
  regr_intercept(avg_shap, ordinal) AS intercept, regr_r2(avg_shap, ordinal) AS r2
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY period) - 1 AS ordinal FROM months) GROUP BY feature"""
_CONFIDENCE = "CASE WHEN r2 > 0.5 THEN 'High' WHEN r2 > 0.2 THEN 'Medium' ELSE 'Low' END"
_DIRECTION = """CASE WHEN mean_shap < 0 AND slope < 0 THEN 'IMPROVING (having greater positive impact)'
  WHEN mean_shap < 0 THEN 'DIMINISHING (having less positive impact)'
  WHEN slope < 0 THEN 'IMPROVING (having less negative impact)'
  ELSE 'WORSENING (having greater negative impact)' END"""
_TREND = {**_MONTHS, "fitted": _TREND_SQL}


@register(
    "shap_trend",
    with_ctes(
        f"""SELECT feature, periods, round(mean_shap, 6) AS mean_shap, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
          round(r2, 6) AS r2, {_CONFIDENCE} AS confidence, {_DIRECTION} AS trend FROM fitted""",
        "attributions",
        extra=_TREND,
    ),
)
def shap_trend(spark, sf):
    df = trends.shap_trend(_monthly(spark, sf))
    rounded = [r6(c, c) for c in ("mean_shap", "slope", "intercept", "r2")]
    return df.select("feature", "periods", *rounded, "confidence", "trend")


_ENDS = {
    "ends": """SELECT feature, min(period) AS first_period, max(period) AS last_period, arg_min(avg_shap, period) AS first_shap,
      arg_max(avg_shap, period) AS last_shap, avg(avg_shap) AS mean_shap, count(*) AS periods FROM months GROUP BY feature""",
}
_PCT = "(last_shap - first_shap) / nullif(abs(first_shap), 0) * 100"


@register(
    "trend_pct_change",
    with_ctes(
        f"""SELECT feature, first_period, last_period, round(first_shap, 6) AS first_shap, round(last_shap, 6) AS last_shap,
          round({_PCT}, 6) AS pct_change FROM ends""",
        "attributions",
        extra={**_MONTHS, **_ENDS},
    ),
)
def trend_pct_change(spark, sf):
    df = trends.trend_change(_monthly(spark, sf))
    rounded = [r6(c, c) for c in ("first_shap", "last_shap", "pct_change")]
    return df.select("feature", "first_period", "last_period", *rounded)


_CORR = {
    "correlated": "SELECT feature, corr(avg_value, avg_shap) AS corr FROM months GROUP BY feature HAVING count(*) > 1",
}
_STRENGTH = "CASE WHEN abs(corr) > 0.7 THEN 'strong' WHEN abs(corr) > 0.3 THEN 'moderate' ELSE 'weak' END"
_SIGN = "CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END"


@register(
    "value_shap_corr",
    with_ctes(
        f"SELECT feature, round(corr, 6) AS corr, {_STRENGTH} AS strength, {_SIGN} AS direction FROM correlated",
        "attributions",
        extra={**_MONTHS, **_CORR},
    ),
)
def value_shap_corr(spark, sf):
    df = trends.value_correlation(_monthly(spark, sf))
    return df.select("feature", r6("corr", "corr"), "strength", "direction")


@register(
    "analysis_bounds",
    with_ctes(
        """SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT activity_id) AS runs,
          count(DISTINCT strftime(date, '%Y-%m')) AS months FROM attributions""",
        "attributions",
    ),
)
def analysis_bounds(spark, sf):
    return trends.analysis_bounds(testbed.attributions(spark, sf))


# ------------------------------------------------------------ report tables


@register(
    "improvement_report",
    with_ctes(
        """SELECT cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature,
          round(importance, 6) AS importance, CASE WHEN mean_shap > 0 THEN 'increasing' ELSE 'decreasing' END AS impact,
          round(value, 6) AS value, round(mean_shap, 6) AS mean_shap,
          'Faster with ' || CASE WHEN mean_shap > 0 THEN 'less' ELSE 'more' END || ' of: ' || feature AS advice
        FROM (SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap, avg(value) AS value FROM attributions
          WHERE date = (SELECT max(date) FROM attributions) GROUP BY feature)""",
        "attributions",
    ),
)
def improvement_report(spark, sf):
    df = reports.improvement_report(testbed.attributions(spark, sf))
    rounded = [r6(c, c) for c in ("importance", "value", "mean_shap")]
    return df.select("rank", "feature", "impact", "advice", *rounded)


@register(
    "improvement_summary",
    with_ctes(
        """SELECT cast(6.75 AS DOUBLE) AS baseline_minutes, '6:45' AS baseline_pace,
          coalesce(string_agg(feature, ', ' ORDER BY importance DESC, feature) FILTER (mean_shap > 0), '') AS raising_features,
          coalesce(string_agg(feature, ', ' ORDER BY importance DESC, feature) FILTER (NOT mean_shap > 0), '') AS lowering_features
        FROM (SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap FROM by_month
          WHERE strftime(date, '%Y') = '1996' GROUP BY feature ORDER BY importance DESC, feature LIMIT 8)""",
        "attributions",
        extra={"by_month": "SELECT activity_id, date, feature || ' ' || strftime(date, '%m') AS feature, value, shap FROM attributions"},
    ),
)
def improvement_summary(spark, sf):
    """The runs of a year as one report, months as features, against a given pace."""
    df = testbed.attributions(spark, sf).filter(F.year("date") == 1996)
    by_month = df.withColumn("feature", F.concat_ws(" ", "feature", F.date_format("date", "MM")))
    return reports.improvement_summary(reports.improvement_report(df, by_month, 8), 6.75)


@register(
    "latest_impact_report",
    with_ctes(
        """SELECT cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, round(importance, 6) AS importance,
          round(mean_shap, 6) AS mean_shap, round(avg_value, 6) AS avg_value, num_runs, run_date,
          CASE WHEN mean_shap > 0 THEN 'slows pace' ELSE 'speeds up pace' END AS direction,
          cast(CASE WHEN mean_shap > 0 THEN ceil(mean_shap * 60) ELSE floor(mean_shap * 60) END AS BIGINT) AS seconds
        FROM (SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap, avg(value) AS avg_value, count(*) AS num_runs, max(date) AS run_date
          FROM attributions WHERE date = (SELECT max(date) FROM attributions) GROUP BY feature)""",
        "attributions",
    ),
)
def latest_impact_report(spark, sf):
    df = reports.latest_impact_report(testbed.attributions(spark, sf))
    rounded = [r6(c, c) for c in ("importance", "mean_shap", "avg_value")]
    return df.select("rank", "feature", *rounded, "num_runs", "run_date", "direction", "seconds")


_IMPACT = {
    "impact": """SELECT cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, *,
      CASE WHEN mean_shap > 0 THEN 'slows pace' ELSE 'speeds up pace' END AS direction,
      cast(CASE WHEN mean_shap > 0 THEN ceil(mean_shap * 60) ELSE floor(mean_shap * 60) END AS BIGINT) AS seconds
    FROM (SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap, avg(value) AS avg_value,
      stddev_samp(value) AS std_value, min(value) AS min_value, max(value) AS max_value, count(*) AS num_runs
      FROM attributions GROUP BY feature)""",
}


@register(
    "impact_report",
    with_ctes(
        """SELECT rank, feature, round(importance, 6) AS importance, round(mean_shap, 6) AS mean_shap, round(avg_value, 6) AS avg_value,
          round(std_value, 6) AS std_value, min_value, max_value, num_runs, direction, seconds FROM impact""",
        "attributions",
        extra=_IMPACT,
    ),
)
def impact_report(spark, sf):
    df = reports.impact_report(testbed.attributions(spark, sf))
    rounded = [r6(c, c) for c in ("importance", "mean_shap", "avg_value", "std_value")]
    return df.select("rank", "feature", *rounded, "min_value", "max_value", "num_runs", "direction", "seconds")


# Months as features give the totals more than one name on each side.
_BY_MONTH = {
    "by_month": "SELECT activity_id, date, feature || ' ' || strftime(date, '%m') AS feature, value, shap FROM attributions",
    "ranked": """SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
      CASE WHEN mean_shap > 0 THEN ceil(mean_shap * 60) ELSE floor(mean_shap * 60) END AS seconds FROM (
        SELECT feature, avg(abs(shap)) AS importance, avg(shap) AS mean_shap FROM by_month GROUP BY feature)""",
    "top": "SELECT * FROM ranked WHERE rank <= 10",
}


def _names_sql(side: str) -> str:
    names = f"(SELECT array_agg(feature ORDER BY rank) FROM top WHERE mean_shap {side} 0)"
    return (
        f"CASE WHEN {names} IS NULL THEN '' WHEN len({names}) = 1 THEN {names}[1] "
        f"ELSE array_to_string({names}[1:len({names}) - 1], ', ') || ' & ' || {names}[len({names})] END"
    )


@register(
    "impact_totals",
    with_ctes(
        f"""SELECT cast(coalesce(sum(seconds) FILTER (mean_shap > 0), 0) AS BIGINT) AS slowing_seconds,
          cast(coalesce(sum(abs(seconds)) FILTER (mean_shap <= 0), 0) AS BIGINT) AS speeding_seconds,
          {_names_sql('>')} AS slowing_features, {_names_sql('<=')} AS speeding_features FROM top""",
        "attributions",
        extra=_BY_MONTH,
    ),
)
def impact_totals(spark, sf):
    df = testbed.attributions(spark, sf)
    by_month = df.withColumn("feature", F.concat_ws(" ", "feature", F.date_format("date", "MM")))
    return reports.impact_totals(reports.impact_report(by_month, 10))


@register(
    "trend_report",
    with_ctes(
        f"""SELECT feature, first_period, last_period, round(first_shap, 6) AS first_shap, round(last_shap, 6) AS last_shap,
          round(ends.mean_shap, 6) AS mean_shap, ends.periods AS periods, round({_PCT}, 6) AS pct_change, round(slope, 6) AS slope, round(r2, 6) AS r2,
          {_CONFIDENCE} AS confidence, {_DIRECTION.replace('mean_shap', 'ends.mean_shap')} AS trend, round(corr, 6) AS corr, {_STRENGTH} || ' ' || {_SIGN} AS correlation
        FROM ends JOIN (SELECT feature, slope, r2 FROM fitted) AS f USING (feature) JOIN correlated USING (feature)""",
        "attributions",
        extra={**_TREND, **_ENDS, **_CORR},
    ),
)
def trend_report(spark, sf):
    df = reports.trend_report(_monthly(spark, sf))
    rounded = [r6(c, c) for c in ("first_shap", "last_shap", "mean_shap", "pct_change", "slope", "r2", "corr")]
    return df.select(
        "feature", "first_period", "last_period", "periods", *rounded, "confidence", "trend", "correlation"
    )


@register(
    "trailing_summary",
    with_ctes(
        """SELECT rank, feature, periods AS months,
          CASE WHEN mean_shap <> 0 AND last_shap - first_shap < 0 THEN 'improved' ELSE 'worsened' END AS verdict,
          (SELECT min(date) FROM recent) AS first_date, (SELECT max(date) FROM recent) AS last_date,
          (SELECT count(DISTINCT activity_id) FROM recent) AS runs
        FROM (SELECT feature, avg(abs(shap)) AS importance, cast(row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS INTEGER) AS rank
          FROM recent GROUP BY feature) AS t
        JOIN (SELECT feature, arg_min(s, period) AS first_shap, arg_max(s, period) AS last_shap, avg(s) AS mean_shap, count(*) AS periods
          FROM (SELECT strftime(date, '%Y-%m') AS period, feature, avg(shap) AS s FROM recent GROUP BY 1, 2) GROUP BY feature) AS e USING (feature)
        WHERE rank <= 3 AND periods >= 2""",
        "attributions",
        extra=_recent("attributions"),
    ),
)
def trailing_summary(spark, sf):
    return reports.trailing_summary(testbed.attributions(spark, sf))


# ------------------------------------------------------------ reshaping

_FEATURES = ["distance", "order_size"]


@register(
    "unpivot_features",
    with_ctes("SELECT activity_id, feature, value FROM attributions", "attributions"),
)
def unpivot_features(spark, sf):
    return encoding.unpivot_features(testbed.order_runs(spark, sf), _FEATURES, ["activity_id"])


@register(
    "pivot_attributions",
    with_ctes(
        """SELECT activity_id, max(CASE WHEN feature = 'distance' THEN shap END) AS shap_distance,
          max(CASE WHEN feature = 'order_size' THEN shap END) AS shap_order_size FROM attributions GROUP BY activity_id""",
        "attributions",
    ),
)
def pivot_attributions(spark, sf):
    return encoding.pivot_attributions(testbed.attributions(spark, sf), _FEATURES)


@register(
    "attribution_join",
    with_ctes(
        """SELECT a.activity_id, a.feature, a.shap, o.runner_id, o.date, o.distance
        FROM attributions a JOIN order_runs o ON a.activity_id = o.activity_id""",
        "attributions",
    ),
)
def attribution_join(spark, sf):
    shap = testbed.attributions(spark, sf).select("activity_id", "feature", "shap")
    return encoding.join_attributions(shap, testbed.order_runs(spark, sf).drop("order_size"))
