"""Scoring requests, model metrics and prediction examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.functions import pace
from paceforge.operators import encoding
from paceforge.schema import q


def history_rollup(df: DataFrame, history: str = "last_7_runs") -> DataFrame:
    """Averages and total from a request's list of earlier runs; absent entries are left out."""

    def present(field: str) -> Column:
        values = F.transform(F.col(history), lambda run: run[field].cast("double"))
        return F.filter(values, lambda v: v.isNotNull())

    def total(values: Column) -> Column:
        added = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, added)

    def mean(values: Column) -> Column:
        return total(values) / F.nullif(F.size(values), F.lit(0))

    distances, rates = present("distance"), present("average_heart_rate")
    return df.withColumns(
        {
            "7d_avg_distance": mean(distances),
            "7d_total_distance": total(distances),
            "7d_avg_heart_rate": mean(rates),
        }
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 in one pass over mergeable sums, optionally per group."""
    y, p = F.col(label), F.col(prediction)
    sums = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    r2 = F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))
    return sums.select(*by, "n", "mae", "rmse", r2.alias("r2"))


def prediction_examples(
    df: DataFrame, key: str = "activity_id", label: str = "label", prediction: str = "prediction", n: int = 10
) -> DataFrame:
    """The first ``n`` scored rows by key, with pace text and absolute error."""
    y, p = F.col(label), F.col(prediction)
    return df.orderBy(key).limit(n).select(
        key,
        y.alias("actual_minutes"),
        p.alias("predicted_minutes"),
        pace.to_colon_truncated(y).alias("actual_pace"),
        pace.to_colon_truncated(p).alias("predicted_pace"),
        F.abs(p - y).alias("error_minutes"),
    )


def best_run(runs: DataFrame, metric: str = "rmse") -> DataFrame:
    """The run with the lowest metric, the smallest name on ties."""
    row = F.struct(*runs.columns)
    best = runs.filter(F.col(metric).isNotNull()).agg(F.min_by(row, F.struct(metric, "config")).alias("r"))
    return best.select("r.*")


def with_pace_text(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Predicted minutes also as ``M:SS``."""
    return df.withColumn("predicted_pace", pace.to_colon(F.col(prediction)))


def recent_runs(df: DataFrame, fields: Sequence[str], n: int = 7, entity: str = "runner_id", time: str = "date", tie: str = "activity_id") -> DataFrame:
    """Each entity's last ``n`` runs as a list of structs.

    The limit is applied before the shuffle as well (window group limit), so an entity with very
    many runs sends at most ``n`` of them per map task.
    """
    order = Window.partitionBy(entity).orderBy(F.desc(time), F.desc(tie))
    last = df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    return last.groupBy(entity).agg(F.collect_list(F.struct(*fields)).alias(f"last_{n}_runs"))


def score_requests(
    requests: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] = ("request_id",), history: str = "last_7_runs"
) -> DataFrame:
    """Predicted pace of requests that carry the run's own numbers and a list of earlier runs.

    The list is rolled up, the model's features are taken in its order, and what a request lacks, a column, a
    value or a history, counts as 0. Returns the kept columns, the features, prediction and predicted_pace.
    """
    rolled = history_rollup(requests, history) if history in requests.columns else requests
    aligned = encoding.align_features(rolled, features, keep)
    filled = aligned.select(*map(q, keep), *[F.coalesce(F.col(q(f)), F.lit(0.0)).alias(f) for f in features])
    scored = with_pace_text(model.transform(filled))
    return scored.select(*map(q, [*keep, *features]), "prediction", "predicted_pace")
