"""Writing stages, exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str) -> None:
    """Parquet between stages; also holds the nested arrays of sequences."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat export with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A report of (..., line, text) rows as one text file in order. Reports are a few hundred lines."""
    keys = [c for c in lines.columns if c != "text"]
    lines.orderBy(*keys).select(F.coalesce("text", F.lit("")).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def write_importance(ranked: DataFrame, folder: str) -> None:
    """Importance table as CSV and as a Markdown rank table."""
    from paceforge.operators import reports

    write_csv(ranked.orderBy("rank").coalesce(1), f"{folder}/importance_csv")
    write_lines(reports.importance_lines(ranked), f"{folder}/importance_md")
