"""Queries over the whole flow and the file-arrival ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceforge import schema, testbed
from paceforge.operators import cleaning
from paceforge.operators.skew import SplitPolicy
from paceforge.plans import flow
from paceforge.plans.oracle_text import BY_RUN, PACED, colon, prime, trailing
from paceforge.plans.querybook import r6, register
from paceforge.schema import q
from paceforge.session import staging_path
from paceforge.streaming import history, ingest
from paceforge.testbed import with_ctes

_PLAIN = ["distance", "elapsed_time", "moving_time", "max_heart_rate", "average_heart_rate", "average_cadence",
          "relative_effort", "average_grade", "max_speed", "temperature"]


def _end_to_end_sql(valid: str) -> str:
    """Oracle of the tabular stage over the rows that pass cleaning."""
    base = f"""SELECT * EXCLUDE (average_cadence), average_cadence * 2 AS average_cadence, {PACED} AS pace_minutes FROM {valid}"""
    history = [
        f"lag(pace_minutes, 1) {BY_RUN} AS p1",
        f"lag(distance, 1) {BY_RUN} AS distance_previous",
        f"lag(average_heart_rate, 1) {BY_RUN} AS heart_rate_previous",
        f"cast(floor((epoch_us(date) - epoch_us(lag(date, 1) {BY_RUN})) / 86400000000) AS BIGINT) AS days_since_last_run",
    ]
    for k in range(1, 5):
        if k > 1:
            history.append(f"lag(pace_minutes, {k}) {BY_RUN} AS p{k}")
        history.append(f'lag(average_cadence, {k}) {BY_RUN} AS "cadence_t-{k}"')
        history.append(f'lag(average_heart_rate, {k}) {BY_RUN} AS "hr_t-{k}"')
    rounded = []
    for days in (7, 30):
        for c, stem in schema.ROLLING_METRICS.items():
            history.append(f'avg({c}) {trailing(days)} AS "{days}d_avg_{stem}"')
            if stem != "pace":
                rounded.append(f'round("{days}d_avg_{stem}", 6) AS "{days}d_avg_{stem}"')
        history.append(f'sum(distance) {trailing(days)} AS "{days}d_total_distance"')
        history.append(f'count(*) {trailing(days)} AS "{days}d_run_count"')
        rounded.append(f'round("{days}d_total_distance", 6) AS "{days}d_total_distance", "{days}d_run_count"')
        pace_name = f'"{days}d_avg_pace"'
        rounded.append(f"{prime(pace_name)} AS {pace_name}")
    lags = [f"{colon(f'p{k}')} AS \"pace_t-{k}\", \"cadence_t-{k}\", \"hr_t-{k}\"" for k in range(1, 5)]
    columns = [
        "activity_id",
        "CASE WHEN n < 10 THEN '0' ELSE '' END || cast(n AS VARCHAR) AS runner_id",
        "date",
        "activity_type",
        *[f"round({c}, 6) AS {c}" for c in _PLAIN],
        "round(pace_minutes, 6) AS pace_minutes",
        f"{prime('pace_minutes')} AS pace",
        "cast(week(date) AS INTEGER) AS week_number",
        "cast(isodow(date) - 1 AS INTEGER) AS day_of_week",
        "cast(month(date) AS INTEGER) AS month",
        "cast(isodow(date) >= 6 AS INTEGER) AS is_weekend",
        f"{prime('p1')} AS pace_previous",
        f"{prime('(pace_minutes - p1)')} AS pace_diff",
        "distance_previous",
        "distance - distance_previous AS distance_diff",
        "heart_rate_previous",
        "average_heart_rate - heart_rate_previous AS heart_rate_diff",
        "days_since_last_run",
        *lags,
        *rounded,
    ]
    ids = f"SELECT runner_id, row_number() OVER (ORDER BY min(activity_id), runner_id) AS n FROM {valid} GROUP BY runner_id"
    return with_ctes(
        f"SELECT {', '.join(columns)} FROM history JOIN ids USING (runner_id)",
        valid,
        extra={"base": base, "history": f"SELECT *, {', '.join(history)} FROM base", "ids": ids},
    )


def _rounded(df):
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(q(c), 6).alias(c) if c in doubles else F.col(q(c)) for c in df.columns])


@register("end_to_end", _end_to_end_sql("valid"))
def end_to_end(spark, sf):
    return _rounded(flow.run(testbed.activities(spark, sf)))


@register("end_to_end_split", _end_to_end_sql("shared_valid"))
def end_to_end_split(spark, sf):
    policy = SplitPolicy(max_rows=200, chunk_rows=500)
    return _rounded(flow.run(testbed.shared_activities(spark, sf), policy=policy))


@register(
    "ingest_status_log",
    with_ctes(
        """SELECT 'success' AS status, (SELECT count(*) FROM activities) AS rows_in, count(*) AS rows_cleaned, count(*) AS rows_tabular FROM valid
        UNION ALL SELECT 'error', 0, 0, 0""",
        "valid",
    ),
)
def ingest_status_log(spark, sf):
    inbox, out = staging_path(spark, "inbox"), staging_path(spark, "ingest")
    raw = testbed.activities(spark, sf)
    raw.write.option("header", True).csv(f"{inbox}/exports")
    # a file that is no CSV is logged as an error
    raw.agg(F.count(F.lit(1)).cast("string").alias("value")).coalesce(1).write.text(f"{inbox}/notes")
    log = ingest.ingest(spark, inbox, out, f"{out}/checkpoint")
    return ingest.log_summary(log)


def _history_sql() -> str:
    lags = ", ".join(
        f'round(lag(pace_minutes, {k}) {BY_RUN}, 6) AS "pace_t-{k}", lag(average_cadence, {k}) {BY_RUN} AS "cadence_t-{k}"' for k in range(1, 5)
    )
    windows = ", ".join(
        f'round(avg({c}) {trailing(days)}, 6) AS "{days}d_avg_{stem}"' for days in (7, 30) for c, stem in schema.ROLLING_METRICS.items()
    )
    totals = ", ".join(
        f'round(sum(distance) {trailing(days)}, 6) AS "{days}d_total_distance", count(*) {trailing(days)} AS "{days}d_run_count"' for days in (7, 30)
    )
    gap = f"cast(floor((epoch_us(date) - epoch_us(lag(date, 1) {BY_RUN})) / 86400000000) AS BIGINT) AS days_since_last_run"
    base = f"SELECT * EXCLUDE (average_cadence), average_cadence * 2 AS average_cadence, {PACED} AS pace_minutes FROM valid"
    return with_ctes(
        f"""SELECT cast(activity_id AS VARCHAR) AS activity_id, runner_id, date, distance, average_cadence,
          round(pace_minutes, 6) AS pace_minutes, lag(distance, 1) {BY_RUN} AS distance_previous, {gap}, {lags}, {windows}, {totals} FROM base""",
        "valid",
        extra={"base": base},
    )


@register("incremental_history", _history_sql())
def incremental_history(spark, sf):
    """The history of four batches, the oldest days last, with corrections and a batch that comes twice."""
    rows = testbed.activities(spark, sf).transform(cleaning.filter_valid_runs)
    day, number = F.dayofmonth("date"), F.col("activity_id")
    late = (day <= 9) | (number % 7 == 0)
    wrong = rows.withColumn("distance", F.when(number % 10 == 3, F.col("distance") / 2).otherwise(F.col("distance")))
    batches = [
        wrong.filter(~late & (day <= 20)),
        rows.filter(~late & (day > 20)),
        rows.filter(late & (day > 4)),
        rows.filter((late & (day <= 4)) | (number % 10 == 3)),
    ]
    table = history.History(spark, staging_path(spark, "history"), buckets=8)
    for k, batch in enumerate(batches):
        table.update(batch, k)
    table.update(batches[1], 1)
    out = table.read()
    named = ["activity_id", "runner_id", "date", "distance", "average_cadence", "distance_previous", "days_since_last_run"]
    exact = [f"cadence_t-{k}" for k in range(1, 5)] + [f"{d}d_run_count" for d in (7, 30)]
    rounded = ["pace_minutes", *[f"pace_t-{k}" for k in range(1, 5)], *[f"{d}d_total_distance" for d in (7, 30)]]
    rounded += [f"{d}d_avg_{stem}" for d in (7, 30) for stem in schema.ROLLING_METRICS.values()]
    return out.select(*named, *[F.col(q(c)) for c in exact], *[r6(q(c), c) for c in rounded])
