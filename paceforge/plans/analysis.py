"""Analyses of a fitted model: all runs, the latest run, and trends over months and weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from paceforge.operators import attribution, reports, selection, trends
from paceforge.session import stage


def explain(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Attributions of all rows, written once; every analysis below reads this table."""
    keep = ["activity_id", "runner_id", "date"]
    return stage(attribution.attributions(model, rows, features, keep), "attributions")


def all_runs(attributions: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    report = reports.impact_report(attributions, top_n)
    return {"impact": report, "totals": reports.impact_totals(report)}


def latest_run(attributions: DataFrame, top_n: int = 5) -> dict[str, DataFrame]:
    """Report on the run at the last date; runs tied for it are averaged."""
    report = reports.improvement_report(attributions, n=top_n)
    return {"improvement": report}


def over_time(
    attributions: DataFrame, months: int | None = 3, top_n: int = 5, features: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Monthly and weekly trends of the top features, or of the features named.

    ``months`` limits the analysis to the trailing months; None takes the full history.
    """
    rows = attributions if months is None else selection.trailing_months(attributions, months)
    if features is None:
        top = selection.top_features(selection.feature_importance(rows), top_n)
        chosen = [r["feature"] for r in top.select("feature").collect()]  # top_n names
    else:
        chosen = list(features)
    rows = selection.choose_features(rows, chosen)
    monthly = trends.period_means(trends.with_month(rows))
    weekly = trends.period_means(trends.with_week(rows))
    out = {
        "monthly": monthly,
        "weekly": weekly,
        "monthly_trend": reports.trend_report(monthly),
        "weekly_trend": reports.trend_report(weekly),
        "trend_lines": trends.value_trend_line(monthly),
        "bounds": trends.analysis_bounds(rows),
        "unknown": selection.unknown_features(attributions, chosen),
    }
    if months is not None:
        out["summary"] = reports.trailing_summary(rows, months)
    return out
