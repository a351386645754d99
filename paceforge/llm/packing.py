"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

A bin holds at most one document of each source and of each cluster of duplicates. Bins stand in the
order of their residual room and carry two bitmaps, sources and clusters. A piece goes to the bin with
the least room that is enough: the search starts at the first bin with room for it and moves to
successors until one is compatible; else a new bin is opened. Pieces come largest first.

Packing runs in groups of about ``group_rows`` documents spread by hash, so no group grows with the
table, one source or one cluster. Pieces that fill a bin alone never enter a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import text_key
from paceforge.session import stage

_WORD = r"[^\x20\x09-\x0D]+"
_GROUP = "group long, tie long, piece int, first_word long, n_words long, bin string, bin_offset long, bin_words long"


def best_fit(sizes: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces are packed in the given order.

    sources and clusters are small numbers; -1 conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (residual, bin)
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        for at in range(bisect_left(order, (size, -1)), len(order)):
            room, b = order[at]
            if not source_bits[b] & s and not cluster_bits[b] & c:
                del order[at]
                break
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        placed.append((b, capacity - room))
        if room > size:
            insort(order, (room - size, b))
    return placed


def _numbers(values: pd.Series) -> list[int]:
    return pd.factorize(values)[0].tolist()  # nulls are -1


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "tie", "piece"], ascending=[False, True, True], kind="stable")
        placed = best_fit(rows["n_words"].tolist(), _numbers(rows["source"]), _numbers(rows["cluster"]), capacity)
        bins = pd.Series([b for b, _ in placed], index=rows.index)
        filled = rows["n_words"].groupby(bins).transform("sum")
        return pd.DataFrame(
            {
                "group": rows["group"],
                "tie": rows["tie"],
                "piece": rows["piece"],
                "first_word": rows["first_word"],
                "n_words": rows["n_words"],
                "bin": rows["group"].astype(str) + "-" + bins.astype(str),
                "bin_offset": [o for _, o in placed],
                "bin_words": filled,
            }
        )

    return run


def pack_documents(
    docs: DataFrame, capacity: int = 2048, group_rows: int = 1_500, source: str = "source", cluster: str | None = None
) -> DataFrame:
    """Pieces of all documents with their places: doc_id, source, cluster, piece, first_word, n_words, bin,
    bin_offset, bin_words.

    A document longer than ``capacity`` words is cut into full pieces, each a bin of its own, and a rest
    that is packed. ``cluster`` names a column with the duplicate cluster; without one, equal texts are a
    cluster. A bin never holds more than ``capacity`` words, nor two pieces that conflict.

    Null or empty text: one piece of no words with a null bin. Null source or cluster conflicts with
    nothing. Repeated rows are packed one by one (they conflict, as equal texts do). Null doc_id is packed
    like others; further columns are ignored; an empty table gives no rows.
    """
    key = F.col(cluster).cast("string") if cluster else F.when(F.col("text") != "", text_key())
    items = stage(
        docs.select(
            "doc_id",
            F.col(source).cast("string").alias("source"),
            key.alias("cluster"),
            F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("words"),
        ).withColumn("tie", F.monotonically_increasing_id()),
        "pack-items",
    )
    rows = items.filter("words > 0").count()
    groups = max(1, -(-rows // group_rows))
    last = F.floor((F.greatest("words", F.lit(1)) - 1) / capacity).cast("int")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "first_word", F.col("piece").cast("long") * capacity
    )
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("first_word"), F.lit(capacity)))
    alone = pieces.filter((F.col("n_words") == 0) | (F.col("n_words") == capacity)).select(
        "doc_id",
        "source",
        "cluster",
        "piece",
        "first_word",
        "n_words",
        F.when(F.col("n_words") > 0, F.concat_ws("-", F.lit("full"), "tie", "piece")).alias("bin"),
        F.lit(0).cast("long").alias("bin_offset"),
        F.col("n_words").alias("bin_words"),
    )
    open_ = pieces.filter((F.col("n_words") > 0) & (F.col("n_words") < capacity)).withColumn(
        "group", F.pmod(F.xxhash64("tie"), F.lit(groups))
    )
    # At most one rest per document, so tie alone leads back to it.
    packed = (
        open_.select("group", "tie", "piece", "first_word", "n_words", "source", "cluster")
        .groupBy("group")
        .applyInPandas(_pack(capacity), _GROUP)
    )
    rests = packed.join(items.select("tie", "doc_id", "source", "cluster"), "tie")
    return alone.unionByName(rests.select(*alone.columns))
