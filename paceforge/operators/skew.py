"""Finding entities too large for one task and cutting them into ordered chunks.

A window per runner puts all rows of that runner into one task. Real runners have a few thousand
activities, but one id (an export without ids, a shared account) may hold a third of the table.
Operators over a runner's history therefore run in two parts:

* ordinary runners: plain windows, one exchange on the runner;
* oversized runners: their rows are range-partitioned by (runner, date, activity) into chunks of
  similar size, windows run per chunk, and what crosses a chunk border is carried over from small
  per-chunk tables.

Both parts return the same rows and values; only the plan differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from paceforge.schema import q
from paceforge.session import stage

CHUNK = "_chunk"
SHARD = "_shard"


@dataclass(frozen=True)
class SplitPolicy:
    """When to leave the plain plan, and how large the pieces should be.

    max_rows: a runner with more rows than this is oversized. None skips the look at the sizes, for
        tables known to have no such runner.
    chunk_rows: target rows per chunk of an oversized runner.
    chunks: at most so many chunks, which hold more rows where these would not do. A chunk is a task, a file and
        sampled keys on the driver, and each step between chunks costs tasks times chunks.
    listed: up to this many oversized runners are named in the plan as literals; beyond it they
        are told apart by joins, so nothing of unknown size is collected or broadcast.
    """

    max_rows: int | None = 2_000_000
    chunk_rows: int = 4_000_000
    chunks: int = 400
    listed: int = 1_000


DEFAULT_POLICY = SplitPolicy()


@dataclass(frozen=True)
class Parts:
    """``ordinary`` always exists; ``oversized`` is None when no runner is too large."""

    ordinary: DataFrame
    oversized: DataFrame | None
    oversized_rows: int = 0


def entity_sizes(df: DataFrame, entity: str, time: str, *measures: Column) -> DataFrame:
    """Rows with a date per entity as ``_n``, and further aggregates; combined before the shuffle."""
    dated = F.col(entity).isNotNull() & F.col(time).isNotNull()
    return df.filter(dated).groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), *measures)


def totals(sizes: DataFrame, *measures: Column) -> Row:
    """``_rows`` and ``_most`` (rows of the largest entity) over a size table, with further aggregates."""
    return sizes.agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"), *measures).first()


def split_oversized(
    df: DataFrame,
    entity: str,
    time: str,
    policy: SplitPolicy = DEFAULT_POLICY,
    sizes: DataFrame | None = None,
    most: int | None = None,
) -> Parts:
    """Separate the rows of oversized entities.

    Costs one count per entity over two columns, unless ``sizes`` already holds it, and nothing where
    ``most``, the rows of the largest entity, is known to be small. Rows without entity or time take
    part in no window; they stay in the ordinary part.
    """
    if policy.max_rows is None or (most is not None and most <= policy.max_rows):
        return Parts(df, None)
    dated = F.col(entity).isNotNull() & F.col(time).isNotNull()
    sizes = entity_sizes(df, entity, time) if sizes is None else sizes
    large = sizes.select(entity, "_n").filter(
        F.col(entity).isNotNull() & (F.col("_n") > policy.max_rows)
    )
    # One bounded job decides: the largest entities, at most listed + 1 rows.
    found = large.orderBy(F.desc("_n")).take(policy.listed + 1)
    if not found:
        return Parts(df, None)
    if len(found) <= policy.listed:
        is_large = F.coalesce(F.col(entity).isin([r[0] for r in found]), F.lit(False)) & dated
        return Parts(df.filter(~is_large), df.filter(is_large), sum(r["_n"] for r in found))
    keys = large.select(entity)
    rows = large.agg(F.sum("_n")).first()[0]
    dated_large = df.filter(dated).join(keys, entity, "left_semi")
    rest = df.filter(dated).join(keys, entity, "left_anti").unionByName(df.filter(~dated))
    return Parts(rest.select(*map(q, df.columns)), dated_large.select(*map(q, df.columns)), rows)


def with_shard(df: DataFrame, entity: str, time: str, tie: str) -> DataFrame:
    """Second partition key of the plain windows.

    Constant for rows that take part, spread by hash for rows without entity or time, so that a
    large share of undated rows does not pile up in one task.
    """
    dated = F.col(entity).isNotNull() & F.col(time).isNotNull()
    spread = F.pmod(F.xxhash64(F.col(tie)), F.lit(65_536)).cast("int") + 1
    return df.withColumn(SHARD, F.when(dated, F.lit(0)).otherwise(spread))


def dated_only(value: Column, entity: str, time: str) -> Column:
    return F.when(F.col(entity).isNotNull() & F.col(time).isNotNull(), value)


def range_chunks(df: DataFrame, order: Sequence[str], rows: int, policy: SplitPolicy, label: str) -> DataFrame:
    """Add ``_chunk``: consecutive pieces of the table in the order of ``order``.

    Range partitioning balances the chunks whatever the key distribution is. The boundaries come
    from a sample, so the numbered rows are written once; every later step sees the same chunks
    even if an executor is lost. Rows equal in all of ``order`` share a chunk, so ``order`` ends
    with the activity key.
    """
    pieces = max(1, min(-(-rows // policy.chunk_rows), policy.chunks))
    ranged = df.repartitionByRange(pieces, *[F.col(q(c)) for c in order])
    return stage(ranged.withColumn(CHUNK, F.spark_partition_id()), label)
