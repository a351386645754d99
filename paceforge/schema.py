"""Canonical activity schema, header aliases and model feature sets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: canonical column -> accepted source headers (first hit wins) ---
ALIASES: dict[str, list[str]] = {
    "activity_id": ["activity_id", "id", "activity_identifier"],
    "runner_id": ["athlete_id", "user_id", "runner_id", "athlete_identifier"],
    "date": ["activity_date", "start_time", "start_date", "date", "activity_datetime"],
    "activity_type": ["activity_type", "type", "sport_type"],
    "distance": ["distance", "distance_km", "distance_miles"],
    "elapsed_time": ["elapsed_time", "total_time", "time"],
    "moving_time": ["moving_time", "active_time"],
    "max_heart_rate": ["max_heart_rate", "max_hr", "heart_rate_max"],
    "average_heart_rate": [
        "average_heart_rate", "avg_heart_rate", "avg_hr", "heart_rate_avg", "heart_rate_average",
    ],
    "max_speed": ["max_speed", "maximum_speed", "speed_max"],
    "average_speed": ["average_speed", "avg_speed", "speed_avg", "speed_average"],
    "pace": ["pace", "average_pace", "avg_pace"],
    "average_grade": ["average_grade", "avg_grade", "grade_avg", "grade_average"],
    "average_cadence": ["average_cadence", "avg_cadence", "cadence_avg", "cadence_average"],
    "relative_effort": ["relative_effort", "effort_score", "training_load"],
    "elevation_gain": ["elevation_gain", "total_elevation_gain", "ascent", "total_ascent"],
    "elevation_loss": ["elevation_loss", "total_elevation_loss", "descent", "total_descent"],
    "temperature": ["temperature", "weather_temperature", "temp"],
    "humidity": ["humidity", "weather_humidity", "relative_humidity"],
}

# --- fixed values: kept columns in their output order, and the numeric ones ---
CANONICAL_COLUMNS: list[str] = [
    "activity_id", "runner_id", "date", "activity_type", "distance", "elapsed_time", "moving_time",
    "max_heart_rate", "average_heart_rate", "max_speed", "average_speed", "pace", "average_grade",
    "average_cadence", "relative_effort", "elevation_gain", "elevation_loss", "temperature", "humidity",
]
ESSENTIAL_COLUMNS: list[str] = ["date", "distance", "elapsed_time"]
NUMERIC_COLUMNS: list[str] = CANONICAL_COLUMNS[4:]

# --- fixed values: metric column -> name used inside rolling feature names ---
ROLLING_METRICS: dict[str, str] = {
    "average_heart_rate": "heart_rate",
    "average_cadence": "cadence",
    "distance": "distance",
    "moving_time": "moving_time",
    "relative_effort": "relative_effort",
    "average_grade": "grade",
    "pace_minutes": "pace",
}

# --- fixed values: inner order of one step of a training sequence ---
SEQUENCE_FEATURES: list[str] = [
    "distance", "average_cadence", "average_heart_rate", "elapsed_time", "average_grade",
    "relative_effort", "pace_minutes",
]

# --- fixed values: tabular column groups, in output order ---
TABULAR_GROUPS: dict[str, list[str]] = {
    "identifiers": ["activity_id", "runner_id", "date", "activity_type"],
    "core": ["distance", "elapsed_time", "moving_time", "pace"],
    "physiological": ["max_heart_rate", "average_heart_rate", "average_cadence", "relative_effort"],
    "route": ["average_grade", "elevation_gain", "elevation_loss", "max_speed", "average_speed"],
    "environment": ["temperature", "humidity"],
    "calendar": ["week_number", "day_of_week", "month", "is_weekend"],
    "previous": [
        "pace_previous", "pace_diff", "distance_previous", "distance_diff",
        "heart_rate_previous", "heart_rate_diff", "days_since_last_run",
    ],
    "lags": [f"{m}_t-{k}" for m in ("pace", "cadence", "hr") for k in range(1, 5)],
    "rolling": [
        "7d_avg_pace", "7d_avg_distance", "7d_avg_heart_rate", "7d_total_distance",
        "7d_avg_relative_effort", "30d_avg_relative_effort", "7d_avg_cadence", "30d_avg_cadence",
    ],
}

# --- fixed values: columns that never enter a model, or only on request ---
IDENTIFIER_COLUMNS: list[str] = ["activity_id", "runner_id", "date", "pace", "activity_type"]
DIRECT_TIME_COLUMNS: list[str] = ["elapsed_time", "moving_time"]
TARGET = "pace_minutes"

DEFAULT_RUNNER = "default_runner"


def normalise_name(name: object) -> str:
    """Header text to a column name: trimmed, lower case, blanks to ``_``, symbols removed."""
    joined = "_".join(str(name).lower().split())
    return re.sub(r"\W", "", joined)


def unique_names(names: Iterable[str]) -> list[str]:
    """Keep the first of repeated headers as it is and number the later ones.

    Spark renames *every* occurrence of a repeated CSV header, which would hide the first one
    from alias matching.
    """
    seen: dict[str, int] = {}
    taken: set[str] = set()
    out: list[str] = []
    for name in names:
        n = seen.get(name, 0)
        candidate = name if n == 0 else f"{name}.{n}"
        while candidate in taken:
            n += 1
            candidate = f"{name}.{n}"
        seen[name] = n + 1
        taken.add(candidate)
        out.append(candidate)
    return out


def alias_mapping(columns: Sequence[str]) -> dict[str, str]:
    """``{source column: canonical name}`` for the first alias present of each canonical column."""
    present = set(columns)
    mapping: dict[str, str] = {}
    for canonical, accepted in ALIASES.items():
        hit = next((name for name in accepted if name in present), None)
        if hit is not None:
            mapping[hit] = canonical
    return mapping


def find_date_column(df: DataFrame, preferred: str = "date") -> str:
    """The preferred date column, else the first whose name mentions date, time or day."""
    if preferred in df.columns:
        return preferred
    for name in df.columns:
        if any(word in name.lower() for word in ("date", "time", "day")):
            return name
    raise ValueError(f"no date-like column among {df.columns}")


def require_columns(df: DataFrame, needed: Sequence[str] = tuple(ESSENTIAL_COLUMNS)) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing essential columns: {missing}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_non_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    numeric = set(numeric_columns(df)) | set(keep)
    return df.select(*[q(c) for c in df.columns if c in numeric])


def q(name: str) -> str:
    """Back-quoted column reference; feature names start with digits or hold dashes."""
    return "`" + name.replace("`", "``") + "`"


def order_tabular(columns: Sequence[str]) -> list[str]:
    """Tabular column order: the fixed groups first, anything else after them as it came."""
    present = set(columns)
    placed = [c for group in TABULAR_GROUPS.values() for c in group if c in present]
    done = set(placed)
    return placed + [c for c in columns if c not in done]


def order_features(columns: Sequence[str]) -> list[str]:
    """Feature-stage order: ids, basics, then heart rate, cadence, elevation, effort and calendar
    columns, then the paired 7/30-day columns, then the rest."""
    windowed = [c for c in columns if c.startswith(("7d_", "30d_"))]
    plain = [c for c in columns if c not in set(windowed)]
    ids = ["activity_id", "runner_id", "date", "activity_type"]
    basics = ["distance", "moving_time", "max_speed"]
    calendar = ["week_number", "day_of_week", "month", "is_weekend", "days_since_last_run"]

    def holding(*words: str) -> list[str]:
        return [c for c in plain if any(w in c for w in words)]

    pairs: list[str] = []
    for col in windowed:
        stem = col.split("d_", 1)[1]
        pairs += [f"7d_{stem}", f"30d_{stem}"]
    wanted = (
        ids + basics + holding("heart_rate") + holding("cadence") + holding("elevation", "grade")
        + holding("effort") + calendar + pairs + list(columns)
    )
    present = set(columns)
    return [c for c in dict.fromkeys(wanted) if c in present]


def select_features(
    columns: Sequence[str],
    pace_history: bool = False,
    direct_time: bool = False,
    keep_pace_diff: bool = False,
) -> list[str]:
    """Model inputs out of the tabular columns.

    ``average_speed`` determines the target and is always left out. ``pace_diff`` together with
    ``pace_previous`` also determines it, so it stays out unless asked for.
    """
    out = []
    for name in columns:
        low = name.lower()
        if name in IDENTIFIER_COLUMNS or name in (TARGET, "average_speed"):
            continue
        if "pace" in low and not pace_history:
            continue
        if name.startswith("pace_diff") and not keep_pace_diff:
            continue
        if name in DIRECT_TIME_COLUMNS and not direct_time:
            continue
        out.append(name)
    return out


# Named model variants: with or without pace history, with or without direct time.
FEATURE_SETS: dict[str, dict[str, bool]] = {
    "no_pace_no_time": {"pace_history": False, "direct_time": False},
    "no_pace_with_time": {"pace_history": False, "direct_time": True},
    "with_pace_no_time": {"pace_history": True, "direct_time": False},
    "with_pace_with_time": {"pace_history": True, "direct_time": True},
}
