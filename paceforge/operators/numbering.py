"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.schema import q
from paceforge.session import stage


def number_sorted(df: DataFrame, by: Sequence[str], name: str, label: str = "numbered") -> DataFrame:
    """Add ``name`` = 1..n in the order of ``by``, any sortable columns.

    Rows are range-partitioned by the sort columns and written once, which pins the partitions. Each
    partition numbers its own rows and adds the rows of the partitions before it, one count per
    partition. Boundaries follow the data, so keys crowded into a narrow range still spread. Rows equal
    in all of ``by`` stay together; end with a unique column where many may be equal.
    """
    order = [F.col(q(c)).asc_nulls_last() for c in by]
    pinned = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    counts = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        pinned.withColumn("_pos", within)
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, (F.col("_pos") + F.col("_before")).cast("bigint"))
        .drop("_part", "_pos", "_before")
    )


def number_rows(df: DataFrame, by: str, tie: str, name: str) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``by``, ``tie`` breaking ties."""
    return number_sorted(df, [by, tie], name)
