"""Turning feature tables into model inputs, and wide/long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge import schema
from paceforge.operators import numbering
from paceforge.schema import q
from paceforge.session import stage


def split_bucket(key: str | Column) -> Column:
    """Stable 0..99 bucket of a key, the same whatever the partitioning."""
    text = (F.col(q(key)) if isinstance(key, str) else key).cast("string")
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint"), F.lit(100))


def hash_split(df: DataFrame, key: str = "activity_id", train: int = 60, valid: int = 20) -> DataFrame:
    """Add ``split``: train, validation or test, by hash of the key (60/20/20)."""
    bucket = split_bucket(key)
    name = F.when(bucket < train, "train").when(bucket < train + valid, "validation").otherwise("test")
    return df.withColumn("split", name)


@dataclass(frozen=True)
class Categories:
    """The values of a column, sorted and numbered from 0, as a table (value, number) in the shared folder."""

    column: str
    values: DataFrame
    count: int


def fit_categories(df: DataFrame, column: str) -> Categories:
    """Number the distinct values of a column over range partitions; nothing is collected."""
    distinct = df.select(F.col(q(column)).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    numbered = numbering.number_sorted(distinct, ["value"], "place", "categories")
    table = stage(numbered.select("value", (F.col("place") - 1).alias("number")), "categories")
    return Categories(column, table, table.count())


def one_hot_sparse(df: DataFrame, categories: Sequence[Categories], suffix: str = "__vector") -> DataFrame:
    """A sparse 0/1 vector ``<column>__vector`` for each column, in the place of the column.

    The first value, missing ones and values that were not there when the categories were fitted give no 1,
    as in :func:`one_hot_drop_first`; place k - 1 of the vector stands for value number k. The dictionary is
    joined by value, so it may have any size; the engine broadcasts it only where it is small.
    """
    for c in categories:
        size = max(1, c.count - 1)
        found = c.values.select(F.col("value").alias("_value"), (F.col("number") - 1).alias("_place"))
        joined = df.join(found, F.col(q(c.column)).cast("string") == F.col("_value"), "left")
        # the place behind the last one is what the encoder leaves out
        kept = F.when(F.col("_place") >= 0, F.col("_place")).otherwise(F.lit(size)).cast("double")
        encoder = OneHotEncoder(inputCol="_index", outputCol=f"{c.column}{suffix}", dropLast=True)
        fitted = encoder.fit(df.sparkSession.createDataFrame([(float(size),)], "_index double"))
        df = fitted.transform(joined.withColumn("_index", kept)).drop("_value", "_place", "_index", c.column)
    return df


def category_values(df: DataFrame, column: str, limit: int | None = 1_000) -> list[str]:
    """Sorted distinct values of a categorical column.

    Every value becomes a column of the plan, so a column of more than ``limit`` values is refused rather than
    cut; :func:`fit_categories` has no such bound.
    """
    distinct = df.select(F.col(q(column)).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    found = [r["v"] for r in (distinct if limit is None else distinct.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories; encode it numerically instead")
    return sorted(found)


def one_hot_drop_first(
    df: DataFrame, columns: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None, limit: int | None = 1_000
) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for all but the first sorted value; missing gives zeros."""
    known = dict(categories or {})
    for c in columns:
        if c not in known:
            known[c] = category_values(df, c, limit)
    dummies = [
        F.coalesce((F.col(q(c)).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in list(known[c])[1:]
    ]
    rest = [F.col(q(c)) for c in df.columns if c not in columns]
    return df.select(*rest, *dummies)


def align_features(df: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The model's features in the model's order; absent ones are 0.

    Without a feature list the numeric columns of the data are used.
    """
    wanted = schema.numeric_columns(df) if features is None else list(features)
    wanted = [c for c in wanted if c not in keep]
    present = set(df.columns)
    columns = [
        F.col(q(c)).cast("double").alias(c) if c in present else F.lit(0.0).alias(c) for c in wanted
    ]
    return df.select(*[F.col(q(c)) for c in keep], *columns)


def unpivot_features(df: DataFrame, features: Sequence[str], ids: Sequence[str], value: str = "value") -> DataFrame:
    """Wide to long: one row per id and feature."""
    doubles = df.select(*map(q, ids), *[F.col(q(f)).cast("double").alias(f) for f in features])
    return doubles.unpivot([F.col(q(i)) for i in ids], [F.col(q(f)) for f in features], "feature", value)


def pivot_attributions(df: DataFrame, features: Sequence[str], key: str = "activity_id") -> DataFrame:
    """Long to wide ``shap_<feature>`` columns. Naming the features avoids a pass to find them."""
    columns = [
        F.first(F.when(F.col("feature") == f, F.col("shap")), ignorenulls=True).alias(f"shap_{f}")
        for f in features
    ]
    return df.groupBy(key).agg(*columns)


def join_attributions(attributions: DataFrame, rows: DataFrame, key: str = "activity_id") -> DataFrame:
    """Attributions with the columns of their activity; the key is unique on the activity side."""
    return attributions.join(rows, key)


def union_parts(df: DataFrame, *names: str) -> DataFrame:
    """Rows of several splits, e.g. train and validation for the final fit."""
    return df.filter(F.col("split").isin(list(names)))
