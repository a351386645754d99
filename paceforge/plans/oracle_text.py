"""SQL snippets shared by the oracles."""

from __future__ import annotations

PACED = "moving_time / 60 / nullif(distance, 0)"


def clock(x: str, mark: str, end: str = "") -> str:
    """Signed pace text: truncated minutes, half-even seconds, 60 seconds carry."""
    minutes = f"cast(trunc(abs({x})) AS BIGINT)"
    seconds = f"cast(round_even((abs({x}) - trunc(abs({x}))) * 60, 0) AS BIGINT)"
    carry = f"CASE WHEN {seconds} = 60 THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN ({x}) IS NULL THEN '' ELSE CASE WHEN ({x}) < 0 THEN '-' ELSE '' END "
        f"|| cast({minutes} + {carry} AS VARCHAR) || '{mark}' "
        f"|| lpad(cast({seconds} % 60 AS VARCHAR), 2, '0') || '{end}' END"
    )


def prime(x: str) -> str:
    return clock(x, "''", '"')


def colon(x: str) -> str:
    return clock(x, ":")


def paced(source: str) -> dict[str, str]:
    return {"paced": f"SELECT *, {PACED} AS pace_minutes FROM {source}"}


def trailing(days: int) -> str:
    """Left-open trailing window (t - days, t]."""
    return (
        "OVER (PARTITION BY runner_id ORDER BY date RANGE BETWEEN "
        f"INTERVAL '{days - 1} days 23:59:59.999999' PRECEDING AND CURRENT ROW)"
    )


BY_RUN = "OVER (PARTITION BY runner_id ORDER BY date, activity_id)"
