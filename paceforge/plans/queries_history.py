"""Queries over runner histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge import schema, testbed
from paceforge.functions import pace
from paceforge.operators import cleaning, imputation, timeline
from paceforge.operators.skew import SplitPolicy
from paceforge.plans.oracle_text import BY_RUN, PACED, colon, paced, prime, trailing
from paceforge.plans.querybook import r6, register
from paceforge.schema import q
from paceforge.testbed import with_ctes

# Sends the shared runner of the test tables through the chunked plans: small limits, many chunks.
SMALL = SplitPolicy(max_rows=200, chunk_rows=300)


def _valid(spark, sf) -> DataFrame:
    return testbed.activities(spark, sf).transform(cleaning.filter_valid_runs)


def _shared(spark, sf) -> DataFrame:
    return testbed.shared_activities(spark, sf).transform(cleaning.filter_valid_runs)


def _paced(df: DataFrame) -> DataFrame:
    return df.withColumn("pace_minutes", pace.from_time(F.col("moving_time"), F.col("distance")))


# ------------------------------------------------------------ previous runs and lags

_PREVIOUS_SQL = f"""
SELECT activity_id, runner_id,
  round(lag(pace_minutes, 1) {BY_RUN}, 6) AS pace_previous,
  lag(distance, 1) {BY_RUN} AS distance_previous,
  lag(average_heart_rate, 1) {BY_RUN} AS heart_rate_previous
FROM paced"""


def _previous_out(df: DataFrame) -> DataFrame:
    return df.select(
        "activity_id", "runner_id", r6("pace_previous", "pace_previous"), "distance_previous", "heart_rate_previous"
    )


@register("prev_run_lags", with_ctes(_PREVIOUS_SQL, "valid", extra=paced("valid")))
def prev_run_lags(spark, sf):
    return _previous_out(timeline.add_previous(_paced(_valid(spark, sf))))


@register("prev_run_lags_split", with_ctes(_PREVIOUS_SQL, "shared_valid", extra=paced("shared_valid")))
def prev_run_lags_split(spark, sf):
    return _previous_out(timeline.add_previous(_paced(_shared(spark, sf)), policy=SMALL))


@register(
    "prev_run_diffs",
    with_ctes(
        f"""SELECT activity_id,
          round(pace_minutes - lag(pace_minutes, 1) {BY_RUN}, 6) AS pace_diff,
          distance - lag(distance, 1) {BY_RUN} AS distance_diff,
          average_heart_rate - lag(average_heart_rate, 1) {BY_RUN} AS heart_rate_diff
        FROM paced""",
        "valid",
        extra=paced("valid"),
    ),
)
def prev_run_diffs(spark, sf):
    df = timeline.add_differences(timeline.add_previous(_paced(_valid(spark, sf))))
    return df.select("activity_id", r6("pace_diff", "pace_diff"), "distance_diff", "heart_rate_diff")


_LAG_COLUMNS = [f"{stem}_t-{k}" for k in range(1, 5) for stem in ("pace", "cadence", "hr")]


def _lag_sql() -> str:
    raw = []
    out = []
    for k in range(1, 5):
        raw.append(f"lag(pace_minutes, {k}) {BY_RUN} AS p{k}")
        raw.append(f'lag(average_cadence, {k}) {BY_RUN} AS "cadence_t-{k}"')
        raw.append(f'lag(average_heart_rate, {k}) {BY_RUN} AS "hr_t-{k}"')
        out.append(f"{colon(f'p{k}')} AS \"pace_t-{k}\", \"cadence_t-{k}\", \"hr_t-{k}\"")
    return f"SELECT activity_id, {', '.join(out)} FROM (SELECT activity_id, {', '.join(raw)} FROM paced)"


def _lag_out(df: DataFrame) -> DataFrame:
    return df.select(
        "activity_id",
        *[
            pace.to_colon(F.col(q(c))).alias(c) if c.startswith("pace") else F.col(q(c))
            for c in _LAG_COLUMNS
        ],
    )


@register("lag_features", with_ctes(_lag_sql(), "valid", extra=paced("valid")))
def lag_features(spark, sf):
    return _lag_out(timeline.add_lags(_paced(_valid(spark, sf))))


@register("lag_features_split", with_ctes(_lag_sql(), "shared_valid", extra=paced("shared_valid")))
def lag_features_split(spark, sf):
    return _lag_out(timeline.add_lags(_paced(_shared(spark, sf)), policy=SMALL))


@register(
    "days_since_last",
    with_ctes(
        f"""SELECT activity_id, cast(floor(
          (epoch_us(date) - epoch_us(lag(date, 1) {BY_RUN})) / 86400000000) AS BIGINT) AS days_since_last_run
        FROM valid""",
        "valid",
    ),
)
def days_since_last(spark, sf):
    return timeline.add_days_since_last(_valid(spark, sf)).select("activity_id", "days_since_last_run")


# ------------------------------------------------------------ trailing windows


def _average_sql(days: int, source: str = "paced") -> str:
    columns = ", ".join(
        f'round(avg({c}) {trailing(days)}, 6) AS "{days}d_avg_{stem}"'
        for c, stem in schema.ROLLING_METRICS.items()
    )
    return f"SELECT activity_id, {columns} FROM {source}"


def _averages(df: DataFrame, days: int, **kw) -> DataFrame:
    spec = timeline.Trailing(schema.ROLLING_METRICS, {}, run_count=False, widths=(days,))
    out = timeline.add_trailing(_paced(df), spec, **kw)
    names = [f"{days}d_avg_{stem}" for stem in schema.ROLLING_METRICS.values()]
    return out.select("activity_id", *[r6(q(n), n) for n in names])


@register("rolling_avg_7d", with_ctes(_average_sql(7), "valid", extra=paced("valid")))
def rolling_avg_7d(spark, sf):
    return _averages(_valid(spark, sf), 7)


@register("rolling_avg_30d", with_ctes(_average_sql(30), "valid", extra=paced("valid")))
def rolling_avg_30d(spark, sf):
    return _averages(_valid(spark, sf), 30)


@register("rolling_avg_7d_split", with_ctes(_average_sql(7), "shared_valid", extra=paced("shared_valid")))
def rolling_avg_7d_split(spark, sf):
    return _averages(_shared(spark, sf), 7, policy=SMALL)


@register(
    "rolling_total_distance",
    with_ctes(
        f"""SELECT activity_id, round(sum(distance) {trailing(7)}, 6) AS "7d_total_distance",
          round(sum(distance) {trailing(30)}, 6) AS "30d_total_distance" FROM valid""",
        "valid",
    ),
)
def rolling_total_distance(spark, sf):
    spec = timeline.Trailing({}, {"distance": "distance"}, run_count=False)
    names = ["7d_total_distance", "30d_total_distance"]
    return timeline.add_trailing(_valid(spark, sf), spec).select("activity_id", *[r6(q(n), n) for n in names])


_COUNT_SQL = f"""SELECT activity_id, count(*) {trailing(7)} AS "7d_run_count",
  count(*) {trailing(30)} AS "30d_run_count" FROM {{}}"""
_COUNTS = timeline.Trailing({}, {})


def _counts_out(df: DataFrame) -> DataFrame:
    return df.select("activity_id", q("7d_run_count"), q("30d_run_count"))


@register("rolling_run_count", with_ctes(_COUNT_SQL.format("valid"), "valid"))
def rolling_run_count(spark, sf):
    return _counts_out(timeline.add_trailing(_valid(spark, sf), _COUNTS))


@register("rolling_run_count_split", with_ctes(_COUNT_SQL.format("shared_valid"), "shared_valid"))
def rolling_run_count_split(spark, sf):
    return _counts_out(timeline.add_trailing(_shared(spark, sf), _COUNTS, policy=SMALL))


@register(
    "rolling_pace_fmt",
    with_ctes(
        f"""SELECT activity_id, {prime('w')} AS "7d_avg_pace", {prime('m')} AS "30d_avg_pace" FROM (
          SELECT activity_id, avg(pace_minutes) {trailing(7)} AS w, avg(pace_minutes) {trailing(30)} AS m FROM paced)""",
        "valid",
        extra=paced("valid"),
    ),
)
def rolling_pace_fmt(spark, sf):
    spec = timeline.Trailing({"pace_minutes": "pace"}, {}, run_count=False)
    df = timeline.add_trailing(_paced(_valid(spark, sf)), spec)
    names = ["7d_avg_pace", "30d_avg_pace"]
    return df.select("activity_id", *[pace.to_prime(F.col(q(n))).alias(n) for n in names])


_TIES_SQL = f"""SELECT activity_id, runner_id, date, round(avg(distance) {trailing(30)}, 6) AS "30d_avg_distance",
  round(sum(distance) {trailing(30)}, 6) AS "30d_total_distance", count(*) {trailing(30)} AS "30d_run_count"
FROM order_runs"""
_TIES = timeline.Trailing({"distance": "distance"}, {"distance": "distance"}, widths=(30,))


def _ties_out(df: DataFrame) -> DataFrame:
    return df.select(
        "activity_id", "runner_id", "date",
        r6(q("30d_avg_distance"), "30d_avg_distance"),
        r6(q("30d_total_distance"), "30d_total_distance"),
        q("30d_run_count"),
    )


@register("rolling_ties", with_ctes(_TIES_SQL, "order_runs"))
def rolling_ties(spark, sf):
    return _ties_out(timeline.add_trailing(testbed.order_runs(spark, sf), _TIES))


@register("rolling_ties_split", with_ctes(_TIES_SQL, "order_runs"))
def rolling_ties_split(spark, sf):
    tiny = SplitPolicy(max_rows=12, chunk_rows=2_000)
    return _ties_out(timeline.add_trailing(testbed.order_runs(spark, sf), _TIES, policy=tiny))


@register(
    "rolling_lineitem",
    with_ctes(
        f"""SELECT activity_id, runner_id, date, distance,
          round(avg(distance) {trailing(7)}, 6) AS "7d_avg_distance", round(avg(distance) {trailing(30)}, 6) AS "30d_avg_distance",
          round(avg(moving_time) {trailing(7)}, 6) AS "7d_avg_moving_time", round(avg(moving_time) {trailing(30)}, 6) AS "30d_avg_moving_time",
          count(*) {trailing(7)} AS "7d_run_count", count(*) {trailing(30)} AS "30d_run_count"
        FROM line_runs""",
        "line_runs",
    ),
)
def rolling_lineitem(spark, sf):
    spec = timeline.Trailing({"distance": "distance", "moving_time": "moving_time"}, {})
    df = timeline.add_trailing(testbed.line_runs(spark, sf), spec)
    averages = [f"{d}d_avg_{m}" for m in ("distance", "moving_time") for d in (7, 30)]
    return df.select(
        "activity_id", "runner_id", "date", "distance", *[r6(q(n), n) for n in averages],
        q("7d_run_count"), q("30d_run_count"),
    )


# ------------------------------------------------------------ fills

_HR = "average_heart_rate"
_FORWARD = f"coalesce({_HR}, last_value({_HR} IGNORE NULLS) OVER (PARTITION BY runner_id ORDER BY date, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_BACKWARD = f"first_value({_HR} IGNORE NULLS) OVER (PARTITION BY runner_id ORDER BY date, activity_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _fill_out(df: DataFrame) -> DataFrame:
    return df.select("activity_id", "runner_id", _HR)


@register(
    "fill_hr_forward",
    with_ctes(f"SELECT activity_id, runner_id, {_FORWARD} AS {_HR} FROM activities", "activities"),
)
def fill_hr_forward(spark, sf):
    return _fill_out(timeline.fill_in_order(testbed.activities(spark, sf), _HR))


_BOTH_SQL = f"SELECT activity_id, runner_id, coalesce({_FORWARD}, {_BACKWARD}) AS {_HR} FROM {{}}"


@register("fill_hr_both", with_ctes(_BOTH_SQL.format("activities"), "activities"))
def fill_hr_both(spark, sf):
    return _fill_out(timeline.fill_in_order(testbed.activities(spark, sf), _HR, backward=True))


@register("fill_hr_both_split", with_ctes(_BOTH_SQL.format("shared_activities"), "shared_activities"))
def fill_hr_both_split(spark, sf):
    return _fill_out(
        timeline.fill_in_order(testbed.shared_activities(spark, sf), _HR, backward=True, policy=SMALL)
    )


# Weeks as entities leave some without any heart rate, so the median has work to do.
@register(
    "fill_hr_median",
    with_ctes(
        f"""SELECT activity_id, runner_id, coalesce({_HR}, (SELECT median({_HR}) FROM sparse_filled)) AS {_HR}
        FROM sparse_filled""",
        "activities",
        extra={
            "sparse": f"SELECT activity_id, runner_id || ' ' || cast(activity_type AS VARCHAR) || ' ' || cast(day(date) AS VARCHAR) AS runner_id, date, {_HR} FROM activities WHERE activity_type IS NOT NULL",
            "sparse_filled": f"SELECT activity_id, runner_id, coalesce({_FORWARD}, {_BACKWARD}) AS {_HR} FROM sparse",
        },
    ),
)
def fill_hr_median(spark, sf):
    df = testbed.activities(spark, sf).filter("activity_type IS NOT NULL")
    key = F.concat_ws(" ", "runner_id", "activity_type", F.dayofmonth("date").cast("string"))
    return _fill_out(imputation.fill_heart_rate(df.withColumn("runner_id", key)))


# ------------------------------------------------------------ sequences

_STEP_FEATURES = ["distance", "average_cadence", "average_heart_rate", "elapsed_time", "average_grade", "relative_effort"]


def _sequence_sql(source: str, target: bool) -> str:
    columns = []
    for k in range(4):
        columns += [f"lead({c}, {k}) {BY_RUN} AS s{k}_{c}" for c in _STEP_FEATURES]
    if target:
        columns = [f"lead({c}, 4) {BY_RUN} AS next_{c}" for c in _STEP_FEATURES]
    names = [c.rsplit(" AS ", 1)[1] for c in columns]
    return f"""SELECT runner_id, start_date, activity_id, {', '.join(names)} FROM (
      SELECT runner_id, date AS start_date, activity_id, {', '.join(columns)},
        row_number() {BY_RUN} AS pos, count(*) OVER (PARTITION BY runner_id) AS n FROM {source}) WHERE pos <= n - 4"""


def _window_out(df: DataFrame) -> DataFrame:
    return df.select(
        "runner_id", "start_date", "activity_id",
        *[F.col("window")[k][i].alias(f"s{k}_{c}") for k in range(4) for i, c in enumerate(_STEP_FEATURES)],
    )


@register("sequence_windows", with_ctes(_sequence_sql("valid", False), "valid"))
def sequence_windows(spark, sf):
    return _window_out(timeline.sequences(_valid(spark, sf), features=_STEP_FEATURES))


@register("sequence_windows_split", with_ctes(_sequence_sql("shared_valid", False), "shared_valid"))
def sequence_windows_split(spark, sf):
    return _window_out(timeline.sequences(_shared(spark, sf), features=_STEP_FEATURES, policy=SMALL))


@register("sequence_targets", with_ctes(_sequence_sql("valid", True), "valid"))
def sequence_targets(spark, sf):
    df = timeline.sequences(_valid(spark, sf), include_targets=True, features=_STEP_FEATURES)
    return df.select(
        "runner_id", "start_date", "activity_id",
        *[F.col("target")[i].alias(f"next_{c}") for i, c in enumerate(_STEP_FEATURES)],
    )


# ------------------------------------------------------------ sequences with all features

_ALL_FEATURES = schema.SEQUENCE_FEATURES
_FULL = {
    "raw": f"""SELECT activity_id, runner_id, date, distance, average_cadence, CASE WHEN average_heart_rate > 30 THEN average_heart_rate END AS average_heart_rate,
      nullif(elapsed_time, 0) AS elapsed_time, average_grade, relative_effort, {PACED} AS pace_minutes FROM activities WHERE lower(activity_type) = 'run'""",
    "steps": "SELECT activity_id, runner_id, date, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM raw)) AS {c}" for c in _ALL_FEATURES) + " FROM raw",
}


def _long_runners(spark, sf) -> DataFrame:
    """Runs with missing heart rates, times and paces."""
    df = _paced(testbed.activities(spark, sf).transform(cleaning.keep_runs))
    return df.withColumns(
        {
            "average_heart_rate": F.when(F.col("average_heart_rate") > 30, F.col("average_heart_rate")),
            "elapsed_time": F.nullif(F.col("elapsed_time"), F.lit(0.0)),
        }
    )


@register(
    "sequence_min_runs",
    with_ctes(
        f"""SELECT runner_id, start_date, activity_id, {", ".join(f"round({c}, 6) AS {c}, round(next_{c}, 6) AS next_{c}" for c in _ALL_FEATURES)} FROM (
          SELECT runner_id, date AS start_date, activity_id, {", ".join(f"{c}, lead({c}, 4) {BY_RUN} AS next_{c}" for c in _ALL_FEATURES)},
            row_number() {BY_RUN} AS pos, count(*) OVER (PARTITION BY runner_id) AS n FROM steps) WHERE pos <= n - 4 AND n >= 42""",
        "activities",
        extra=_FULL,
    ),
)
def sequence_min_runs(spark, sf):
    """Windows of runners with 42 runs or more, over all features, missing values filled by the median."""
    df = timeline.sequences(_long_runners(spark, sf), include_targets=True, min_length=42)
    first, target = F.col("window")[0], F.col("target")
    values = [c for i, name in enumerate(_ALL_FEATURES) for c in (F.round(first[i], 6).alias(name), F.round(target[i], 6).alias(f"next_{name}"))]
    return df.select("runner_id", "start_date", "activity_id", *values)
