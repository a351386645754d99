"""Queries over schema, cleaning, imputation, pace and calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceforge import testbed
from paceforge.functions import calendar, pace
from paceforge.operators import cleaning, imputation
from paceforge.plans.oracle_text import PACED, clock, colon, paced, prime
from paceforge.plans.querybook import r6, register
from paceforge.testbed import with_ctes

# ------------------------------------------------------------ schema and typing

# An export with free-form headers, text cells, two aliases of one column and an unknown column.
_RAW = {
    " Activity ID ": "event_id",
    "Athlete ID": "user_id",
    "Activity Date": "cast(ts as string)",
    "Type": "event_type",
    "Distance KM": "cast(value as string)",
    "Avg HR": "case when event_type = 'error' then 'n/a' else cast(60 + user_id % 100 as string) end",
    "Device!": "props",
}


def _raw(spark, sf):
    return testbed.table(spark, sf, "events").selectExpr(*[f"{e} AS `{n}`" for n, e in _RAW.items()])


@register(
    "standardize_columns",
    """SELECT event_id AS activity_id, user_id AS runner_id, event_type AS activity_type,
      value AS distance, CASE WHEN event_type = 'error' THEN 'n/a' ELSE cast(60 + user_id % 100 AS VARCHAR) END AS average_heart_rate,
      props AS device FROM events""",
)
def standardize_columns(spark, sf):
    df = cleaning.standardise_columns(_raw(spark, sf))
    # engines print doubles differently, so the text column is compared as a number
    return df.drop("date").withColumn("distance", pace.number(F.col("distance")))


@register(
    "select_relevant",
    "SELECT event_id AS activity_id, user_id AS runner_id, event_type AS activity_type FROM events",
)
def select_relevant(spark, sf):
    df = cleaning.standardise_columns(_raw(spark, sf)).drop("date", "distance", "average_heart_rate")
    return cleaning.select_relevant(df)


_DATE_TEXT = """CASE event_type
  WHEN 'error' THEN 'not a date'
  WHEN 'click' THEN concat(month(ts), '/', day(ts), '/', year(ts), ' ', hour(ts), ':', substr(cast(100 + minute(ts) as string), 2, 2))
  ELSE cast(ts as string) END"""


@register(
    "parse_dates",
    """SELECT event_id AS activity_id, CASE event_type WHEN 'error' THEN NULL
      WHEN 'click' THEN date_trunc('minute', ts) ELSE ts END AS date FROM events""",
)
def parse_dates(spark, sf):
    df = testbed.table(spark, sf, "events").selectExpr("event_id AS activity_id", f"{_DATE_TEXT} AS date")
    return cleaning.parse_dates(df)


_DIRTY = {
    "activity_id": "event_id",
    "distance": "case when event_type = 'error' then 'n/a' when event_type = 'view' then concat('  ', cast(user_id as string), ' ') else cast(user_id as string) end",
    "elapsed_time": "case when event_type = 'signup' then '' when event_type = 'click' then 'NaN' else concat(cast(user_id as string), '.25') end",
    "max_speed": "case when event_type = 'click' then 'Infinity' when event_type = 'error' then cast(null as string) else '1e3' end",
}


@register(
    "coerce_numeric",
    """SELECT event_id AS activity_id,
      CASE WHEN event_type = 'error' THEN NULL ELSE cast(user_id AS DOUBLE) END AS distance,
      CASE WHEN event_type IN ('signup', 'click') THEN NULL ELSE user_id + cast(0.25 AS DOUBLE) END AS elapsed_time,
      CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE cast(1000 AS DOUBLE) END AS max_speed FROM events""",
)
def coerce_numeric(spark, sf):
    df = testbed.table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in _DIRTY.items()])
    return cleaning.coerce_numeric(df)


@register(
    "default_runner",
    with_ctes("SELECT activity_id, distance, 'default_runner' AS runner_id FROM activities", "activities"),
)
def default_runner(spark, sf):
    return testbed.activities(spark, sf).select("activity_id", "distance").transform(cleaning.default_runner)


@register(
    "dense_runner_ids",
    with_ctes(
        """SELECT activity_id, CASE WHEN n < 10 THEN '0' ELSE '' END || cast(n AS VARCHAR) AS runner_id
        FROM activities JOIN (SELECT runner_id, row_number() OVER (ORDER BY min(activity_id)) AS n
          FROM activities GROUP BY runner_id) AS ids USING (runner_id)""",
        "activities",
    ),
)
def dense_runner_ids(spark, sf):
    df = testbed.activities(spark, sf).select("activity_id", "runner_id")
    return cleaning.dense_runner_ids(df)


# ------------------------------------------------------------ row rules


@register(
    "filter_activity_type",
    with_ctes("SELECT activity_id, activity_type FROM activities WHERE activity_type = 'Run'", "activities"),
)
def filter_activity_type(spark, sf):
    return testbed.activities(spark, sf).transform(cleaning.keep_runs).select("activity_id", "activity_type")


@register(
    "filter_valid",
    with_ctes(
        "SELECT activity_id, runner_id, date, distance, elapsed_time, average_heart_rate FROM valid", "valid"
    ),
)
def filter_valid(spark, sf):
    df = testbed.activities(spark, sf).transform(cleaning.filter_valid_runs)
    return df.select("activity_id", "runner_id", "date", "distance", "elapsed_time", "average_heart_rate")


@register(
    "cleaning_audit",
    with_ctes(
        """SELECT count(*) AS rows_in,
          count(*) FILTER (NOT run) AS rejected_activity_type,
          count(*) FILTER (run AND NOT dist) AS rejected_distance,
          count(*) FILTER (run AND dist AND NOT el) AS rejected_elapsed_time,
          count(*) FILTER (run AND dist AND el AND NOT hr) AS rejected_average_heart_rate,
          count(*) FILTER (run AND dist AND el AND hr) AS rows_out,
          count(DISTINCT runner_id) FILTER (run AND dist AND el AND hr) AS runners_out
        FROM (SELECT runner_id, coalesce(lower(activity_type) = 'run', false) AS run,
          coalesce(distance > 0 AND distance < 100, false) AS dist, coalesce(elapsed_time > 0, false) AS el,
          coalesce(average_heart_rate > 30 AND average_heart_rate < 250, false) AS hr FROM activities)""",
        "activities",
    ),
)
def cleaning_audit(spark, sf):
    return cleaning.audit(testbed.activities(spark, sf))


# ------------------------------------------------------------ imputation

_FILLED = ["distance", "average_heart_rate", "max_speed"]


def _gappy(spark, sf):
    df = testbed.activities(spark, sf)
    missing = F.col("activity_type").isNull()
    return df.select(
        "activity_id", "activity_type", *[F.when(~missing, F.col(c)).alias(c) for c in _FILLED]
    )


_GAPPY = {
    "gappy": "SELECT activity_id, activity_type, "
    + ", ".join(f"CASE WHEN activity_type IS NOT NULL THEN {c} END AS {c}" for c in _FILLED)
    + " FROM activities"
}


def _impute_sql(fn: str) -> str:
    columns = ", ".join(
        f"round(coalesce({c}, (SELECT {fn}({c}) FROM gappy)), 6) AS {c}" for c in _FILLED
    )
    return with_ctes(f"SELECT activity_id, {columns} FROM gappy", "activities", extra=_GAPPY)


@register("impute_mean", _impute_sql("avg"))
def impute_mean(spark, sf):
    df = imputation.impute_mean(_gappy(spark, sf), _FILLED)
    return df.select("activity_id", *[r6(c, c) for c in _FILLED])


@register("impute_median", _impute_sql("median"))
def impute_median(spark, sf):
    df = imputation.impute_median(_gappy(spark, sf), _FILLED)
    return df.select("activity_id", *[r6(c, c) for c in _FILLED])


@register(
    "impute_mode",
    with_ctes(
        """SELECT activity_id, coalesce(activity_type, (SELECT activity_type FROM activities
          WHERE activity_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, activity_type LIMIT 1)) AS activity_type,
          coalesce(band, (SELECT band FROM (SELECT CASE WHEN activity_type = 'Run' THEN cast(activity_id % 7 AS VARCHAR) END AS band FROM activities)
            WHERE band IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, band LIMIT 1)) AS band
        FROM (SELECT activity_id, activity_type, CASE WHEN activity_type = 'Run' THEN cast(activity_id % 7 AS VARCHAR) END AS band FROM activities)""",
        "activities",
    ),
)
def impute_mode(spark, sf):
    band = F.when(F.col("activity_type") == "Run", (F.col("activity_id") % 7).cast("string"))
    df = testbed.activities(spark, sf).select("activity_id", "activity_type", band.alias("band"))
    return imputation.impute_mode(df, ["activity_type", "band"])


_PROFILED = ["activity_type", "average_heart_rate", "distance"]


@register(
    "null_profile",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_ratio FROM activities"
            for c in _PROFILED
        ),
        "activities",
    ),
)
def null_profile(spark, sf):
    df = imputation.null_profile(testbed.activities(spark, sf), _PROFILED)
    return df.select("column_name", "null_count", r6("null_ratio", "null_ratio"))


@register(
    "drop_null_rows",
    with_ctes(
        "SELECT activity_id, activity_type, average_heart_rate FROM activities WHERE activity_type IS NOT NULL AND average_heart_rate IS NOT NULL",
        "activities",
    ),
)
def drop_null_rows(spark, sf):
    df = testbed.activities(spark, sf).select("activity_id", "activity_type", "average_heart_rate")
    return imputation.drop_null_rows(df)


# ------------------------------------------------------------ pace text

# Text in every accepted form, built from the rows.
_PACE_TEXT = r"""CASE event_type
  WHEN 'click' THEN concat(user_id % 12, "'", lpad(user_id % 60, 2, '0'), '"')
  WHEN 'view' THEN concat(user_id % 12, ':', lpad(user_id % 60, 2, '0'), if(user_id % 2 = 0, ':15', ''))
  WHEN 'purchase' THEN concat('-', user_id % 12, "'", lpad(user_id % 60, 2, '0'), '"')
  WHEN 'signup' THEN concat(user_id % 12, '.5')
  ELSE CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN concat(user_id, "'") ELSE concat('-', user_id) END
END"""

_M, _S = "cast(user_id % 12 AS DOUBLE)", "cast(user_id % 60 AS DOUBLE) / 60"


def _pace_case(click: str, view: str, purchase: str, signup: str, bare: str) -> str:
    return (
        f"SELECT event_id AS activity_id, round(CASE event_type WHEN 'click' THEN {click} WHEN 'view' THEN {view} "
        f"WHEN 'purchase' THEN {purchase} WHEN 'signup' THEN {signup} "
        f"ELSE CASE WHEN user_id % 4 = 3 THEN {bare} END END, 6) + cast(0 AS DOUBLE) AS minutes FROM events"
    )


def _pace_texts(spark, sf):
    return testbed.table(spark, sf, "events").selectExpr("event_id AS activity_id", f"{_PACE_TEXT} AS text")


def _parsed(spark, sf, fn):
    return _pace_texts(spark, sf).select("activity_id", r6(fn(F.col("text")), "minutes"))


@register(
    "pace_parse",
    _pace_case(f"{_M} + {_S}", f"{_M} + {_S}", f"-{_M} + {_S}", f"{_M} + 0.5", "-cast(user_id AS DOUBLE)"),
)
def pace_parse(spark, sf):
    return _parsed(spark, sf, pace.parse)


@register(
    "pace_parse_signed",
    _pace_case(f"{_M} + {_S}", f"{_M} + {_S}", f"-({_M} + {_S})", f"{_M} + 0.5", "-cast(user_id AS DOUBLE)"),
)
def pace_parse_signed(spark, sf):
    return _parsed(spark, sf, pace.parse_signed)


@register("pace_target", _pace_case(f"{_M} + {_S}", "NULL", f"-{_M} + {_S}", "NULL", "NULL"))
def pace_target(spark, sf):
    return _parsed(spark, sf, pace.parse_target)


def _paces(spark, sf):
    df = testbed.activities(spark, sf)
    return df.withColumn("pace_minutes", pace.from_time(F.col("moving_time"), F.col("distance")))


@register(
    "pace_format",
    with_ctes(f"SELECT activity_id, {prime('pace_minutes')} AS pace FROM paced", "activities", extra=paced("activities")),
)
def pace_format(spark, sf):
    return _paces(spark, sf).select("activity_id", pace.to_prime(F.col("pace_minutes")).alias("pace"))


@register(
    "pace_format_colon",
    with_ctes(
        f"SELECT activity_id, {colon('(pace_minutes - 10)')} AS pace FROM paced", "activities", extra=paced("activities")
    ),
)
def pace_format_colon(spark, sf):
    return _paces(spark, sf).select("activity_id", pace.to_colon(F.col("pace_minutes") - 10).alias("pace"))


@register(
    "pace_diff",
    with_ctes(
        f"SELECT activity_id, {clock('(pace_minutes - 12)', chr(39) * 2, chr(34))} AS pace_diff FROM paced",
        "activities",
        extra=paced("activities"),
    ),
)
def pace_diff(spark, sf):
    minutes = F.col("pace_minutes") - 12
    return _paces(spark, sf).select("activity_id", pace.to_prime(minutes).alias("pace_diff"))


@register(
    "pace_format_trunc",
    with_ctes(
        """SELECT activity_id, cast(cast(trunc(pace_minutes) AS BIGINT) AS VARCHAR) || ':' ||
          lpad(cast(cast(floor((pace_minutes - floor(pace_minutes)) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS pace FROM paced""",
        "activities",
        extra=paced("activities"),
    ),
)
def pace_format_trunc(spark, sf):
    return _paces(spark, sf).select("activity_id", pace.to_colon_truncated(F.col("pace_minutes")).alias("pace"))


@register(
    "pace_from_time",
    with_ctes(f"SELECT activity_id, round({PACED}, 6) AS pace_minutes FROM activities", "activities"),
)
def pace_from_time(spark, sf):
    return _paces(spark, sf).select("activity_id", r6("pace_minutes", "pace_minutes"))


@register(
    "pace_from_speed",
    with_ctes(
        "SELECT activity_id, round(60 / nullif(max_speed, 0), 6) AS pace_minutes FROM activities", "activities"
    ),
)
def pace_from_speed(spark, sf):
    df = testbed.activities(spark, sf)
    return df.select("activity_id", r6(pace.from_speed(F.col("max_speed")), "pace_minutes"))


# ------------------------------------------------------------ calendar


@register(
    "calendar_features",
    """SELECT o_orderkey AS activity_id, cast(week(o_orderdate) AS INTEGER) AS week_number,
      cast(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, cast(month(o_orderdate) AS INTEGER) AS month,
      cast(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend FROM orders""",
)
def calendar_features(spark, sf):
    d = F.col("date")
    return testbed.order_runs(spark, sf).select(
        "activity_id",
        calendar.week_number(d).alias("week_number"),
        calendar.day_of_week(d).alias("day_of_week"),
        F.month(d).alias("month"),
        calendar.is_weekend(d).alias("is_weekend"),
    )


@register(
    "date_parts",
    """SELECT o_orderkey AS activity_id, cast(year(o_orderdate) AS INTEGER) AS year, cast(month(o_orderdate) AS INTEGER) AS month,
      monthname(o_orderdate) AS month_name, cast(quarter(o_orderdate) AS INTEGER) AS quarter,
      strftime(o_orderdate, '%Y-%m') AS year_month, cast(week(o_orderdate) AS INTEGER) AS week FROM orders""",
)
def date_parts(spark, sf):
    parts = calendar.date_parts(F.col("date"))
    return testbed.order_runs(spark, sf).select("activity_id", *[c.alias(n) for n, c in parts.items()])


@register(
    "seconds_impact",
    with_ctes(
        """SELECT activity_id, feature, cast(CASE WHEN shap > 0 THEN ceil(shap * 60) ELSE floor(shap * 60) END AS BIGINT) AS seconds
        FROM attributions""",
        "attributions",
    ),
)
def seconds_impact(spark, sf):
    return testbed.attributions(spark, sf).select(
        "activity_id", "feature", calendar.seconds_impact(F.col("shap")).alias("seconds")
    )


_AGO = """SELECT activity_id, cast(floor((epoch_us((SELECT max(date) FROM order_runs)) - epoch_us(date)) / 86400000000) AS BIGINT) AS days_ago
FROM order_runs"""


@register(
    "week_bins",
    with_ctes(
        f"""SELECT activity_id, days_ago, cast(CASE WHEN greatest(1, ceil(days_ago / 7)) <= 13
          THEN greatest(1, ceil(days_ago / 7)) END AS INTEGER) AS week_bin FROM ({_AGO})""",
        "order_runs",
    ),
)
def week_bins(spark, sf):
    from paceforge.operators import selection

    df = selection.add_week_bins(testbed.order_runs(spark, sf))
    return df.select("activity_id", "days_ago", "week_bin")
