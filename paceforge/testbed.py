"""Projection of the driver tables to the canonical schema.

The expressions are plain SQL that Spark and DuckDB both read, so queries and oracles start from
the same rows. Measures are multiples of powers of two: their sums are exact in any order, and
the two engines can be compared digit by digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paceforge.schema import q

# props reads {"k": 0..99}; a substring costs far less than a pattern and is used many times
_K = "cast(substr(props, 7, length(props) - 7) as int)"
_DISTANCE = "cast(floor(value * 16) as double) / cast(32 as double)"

ACTIVITIES: dict[str, str] = {
    "activity_id": "event_id",
    "runner_id": "cast(user_id as string)",
    "date": "ts",
    "activity_type": (
        "case when event_type in ('click', 'view', 'purchase') then 'Run' "
        "when event_type = 'signup' then 'Ride' end"
    ),
    "distance": f"case when {_K} = 3 then cast(0 as double) else {_DISTANCE} end",
    "elapsed_time": f"case when {_K} = 13 then cast(0 as double) else cast(630 + 60 * {_K} as double) end",
    "moving_time": f"cast(600 + 60 * {_K} as double)",
    "max_heart_rate": f"cast(60 + 2 * {_K} as double)",
    "average_heart_rate": (
        f"case when {_K} = 99 then cast(255 as double) "
        f"when {_K} % 10 = 7 then cast(null as double) else cast(25 + 2 * {_K} as double) end"
    ),
    "max_speed": "cast(floor(value * 8) as double) / cast(64 as double)",
    "average_grade": f"cast({_K} - 50 as double) / cast(8 as double)",
    "average_cadence": f"cast(60 + {_K} % 40 as double)",
    "relative_effort": f"cast({_K} as double) * cast(1.5 as double)",
    "temperature": f"cast({_K} % 35 as double)",
}

# One shared device id for a third of the runs, to drive the plans for oversized runners.
SHARED_RUNNER = "case when event_type = 'purchase' then 'shared' else cast(user_id as string) end"

ORDER_RUNS: dict[str, str] = {
    "activity_id": "o_orderkey",
    "runner_id": "cast(o_custkey as string)",
    "date": "o_orderdate",
    "distance": "cast(floor(o_totalprice / 5000 * 16) as double) / cast(16 as double)",
    "order_size": "cast(floor(o_totalprice / 1000 * 16) as double) / cast(16 as double)",
}

LINE_RUNS: dict[str, str] = {
    "activity_id": "l_orderkey * 8 + l_linenumber",
    "runner_id": "cast(l_suppkey as string)",
    "date": "l_shipdate",
    "distance": "l_quantity",
    "moving_time": "cast(floor(l_extendedprice) as double)",
}


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _project(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return _read(spark, sf_dir, table).selectExpr(*[f"{e} AS {q(n)}" for n, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, name)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "events", ACTIVITIES)


def shared_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "events", {**ACTIVITIES, "runner_id": SHARED_RUNNER})


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "orders", ORDER_RUNS)


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir, "lineitem", LINE_RUNS)


# Stand-in attributions over the order runs: deterministic, not centred, checkable in SQL.
_CENTRES = {"distance": 40, "order_size": 200}
_SHAP = (
    "(cast(floor((value - centre) * 16) as double) / cast(16384 as double)) "
    "+ cast((activity_id * 7919 + 31 * length(feature)) % 201 - 90 as double) / cast(1024 as double)"
)


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (activity_id, runner_id, date, feature, value, shap)."""
    runs = order_runs(spark, sf_dir)
    stacked = ", ".join(f"'{n}', {n}, cast({c} as double)" for n, c in _CENTRES.items())
    return runs.selectExpr(
        "activity_id", "runner_id", "date", f"stack({len(_CENTRES)}, {stacked}) AS (feature, value, centre)"
    ).selectExpr("activity_id", "runner_id", "date", "feature", "value", f"{_SHAP} AS shap")


_VALID = (
    "lower(activity_type) = 'run' AND distance > 0 AND distance < 100 AND elapsed_time > 0 "
    "AND average_heart_rate > 30 AND average_heart_rate < 250"
)
_LONG = " UNION ALL ".join(
    f"SELECT activity_id, runner_id, date, '{n}' AS feature, {n} AS value, cast({c} as double) AS centre FROM order_runs"
    for n, c in _CENTRES.items()
)

# Common table expressions for the oracles, in dependency order.
_CTES: dict[str, tuple[list[str], str]] = {
    "activities": ([], _select(ACTIVITIES, "events")),
    "shared_activities": ([], _select({**ACTIVITIES, "runner_id": SHARED_RUNNER}, "events")),
    "order_runs": ([], _select(ORDER_RUNS, "orders")),
    "line_runs": ([], _select(LINE_RUNS, "lineitem")),
    "valid": (["activities"], f"SELECT * FROM activities WHERE {_VALID}"),
    "shared_valid": (["shared_activities"], f"SELECT * FROM shared_activities WHERE {_VALID}"),
    "attributions": (
        ["order_runs"],
        f"SELECT activity_id, runner_id, date, feature, value, {_SHAP} AS shap FROM ({_LONG}) AS l",
    ),
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named common table expressions and those they need."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for parent in _CTES[name][0]:
            need(parent)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in wanted]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"
