"""Comparison and plan helpers for the tests."""

from __future__ import annotations

import math
import re


def approx_rows(rows):
    """Rows as sortable tuples with floats cut to nine significant digits."""
    out = []
    for row in rows:
        out.append(tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row))
    return sorted(out)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    pick = [f"`{n}`" for n in names]
    left, right = approx_rows(a.select(*pick).collect()), approx_rows(b.select(*pick).collect())
    assert len(left) == len(right)
    assert left == right


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


def count_nodes(df, name: str) -> int:
    return len(re.findall(rf"^[\s:+\-*()0-9]*{name}\b", plan(df), flags=re.M))
