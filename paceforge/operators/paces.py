"""Rendering many pace columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.functions import pace
from paceforge.schema import q


def render(df: DataFrame, prime: Sequence[str] = (), colon: Sequence[str] = ()) -> DataFrame:
    """Replace minute columns by text, ``M'SS"`` or ``M:SS``.

    Whole seconds come first and text second, as two projections: each column's seconds are worked
    out once, and the generated code stays small enough for the JVM to compile it.
    """
    forms = {**{c: pace.PRIME for c in prime}, **{c: pace.COLON for c in colon}}
    if not forms:
        return df
    numbered = list(enumerate(forms.items()))
    seconds = {f"_s{i}": F.expr(pace.total_seconds_sql(q(c))) for i, (c, _) in numbered}
    texts = {c: F.expr(pace.clock_sql(q(c), f"_s{i}", *form)) for i, (c, form) in numbered}
    return df.withColumns(seconds).withColumns(texts).drop(*seconds)
