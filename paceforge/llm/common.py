"""Helpers the text operators share: words, hashes, row keys and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.session import discard, stage

#: ASCII A-Z to a-z; other letters stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Java regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"

Tables = Iterator[pa.RecordBatch]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\t-\\r; bytes.split() cuts at exactly these six."""
    return text.split() if text else []


def utf8(column: str) -> Column:
    """Text as bytes, so that Arrow hands it over without decoding."""
    return F.col(column).cast("binary")


def text_key(column: str = "text") -> Column:
    """Identity of a text: two 64-bit hashes with different seeds, null for null."""
    c = F.col(column)
    return F.when(c.isNotNull(), F.concat_ws("-", F.hex(F.xxhash64(c)), F.hex(F.xxhash64(F.lit("k"), c))))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name in df.columns:
        name = "_" + name
    return name


def with_text_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a bigint ``name`` that is the same for rows equal in doc_id and text, and only for them.

    It is the doc_id where that names a single text. A null doc_id, and the other texts of a repeated one,
    get a number above 2^62 from a hash of doc_id and text, so they come after all usual ids.
    """
    text_id = F.coalesce(text_key(), F.lit(""))
    derived = F.lit(1 << 62) + F.pmod(F.xxhash64(F.col("doc_id"), text_id), F.lit(1 << 61))
    own = F.col("doc_id").cast("bigint")
    crowded = (
        docs.groupBy("doc_id")
        .agg(F.min(text_id).alias("first"), F.max(text_id).alias("last"))
        .filter("doc_id IS NOT NULL AND first <> last")
        .select(F.col("doc_id").alias("id"), "first")
    )
    if not crowded.limit(1).count():
        return docs.withColumn(name, F.coalesce(own, derived))
    joined = docs.alias("d").join(crowded.alias("c"), F.col("d.doc_id") == F.col("c.id"), "left")
    moved = F.col("d.doc_id").isNull() | (F.coalesce(text_key("d.text"), F.lit("")) != F.col("c.first"))
    derived = F.lit(1 << 62) + F.pmod(F.xxhash64(F.col("d.doc_id"), F.coalesce(text_key("d.text"), F.lit(""))), F.lit(1 << 61))
    return joined.select("d.*", F.when(F.coalesce(moved, F.lit(False)), derived).otherwise(F.col("d.doc_id").cast("bigint")).alias(name))


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of every ``key``; rows whose key is not repeated are not shuffled with their columns."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("repeated"))
    if not repeated.limit(1).count():
        return rows
    again = F.col(f"r.{key}") == F.col("k.repeated")
    alone = rows.alias("r").join(repeated.alias("k"), again, "left_anti")
    several = rows.alias("r").join(repeated.alias("k"), again, "left_semi")
    one = several.groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))
    return alone.unionByName(one.select("row.*"))


class WordHashes(dict):
    """64-bit hash of each word seen, computed once; emptied when it grows past ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> _S32)) * _M2
    return a ^ (a >> _S32)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; the order of the words counts.

    Spans of power-of-two length are combined from two halves, so a window of 50 takes eight passes.
    """
    if len(words) < n:
        return words[:0]
    power, width, have, acc = words, 1, 0, None
    rest = n
    while rest:
        if rest & 1:
            part = power[have : have + len(words) - n + 1]
            acc = part.copy() if acc is None else mix(acc * _M1 + part)
            have += width
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - width] * _M1 + power[width:] + np.uint64(width))
            width *= 2
    return mix(acc + np.uint64(n))


def by_batch(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to a dict of columns (one batch in, one out)."""

    def run(batches: Tables) -> Tables:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(batch))

    return df.mapInArrow(run, schema)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, share: int = 1, parts: int = 1_000) -> DataFrame:
    """Inner join on ``keys``, unique in ``right``, where ``n`` says how many rows of ``left`` have the key.

    Keys above one part in ``parts`` of all rows are fewer than ``share * parts`` if a row has ``share`` keys;
    they go by broadcast, so that no task receives the rows of a hot key.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * parts * share > total
    heads = F.broadcast(right.filter(hot))
    rest = left.join(heads.select(*keys), keys, "left_anti").join(right.filter(~hot), keys)
    return left.join(heads, keys).unionByName(rest)


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Smallest id reachable over the undirected links (a, b): columns id, component.

    Alternates neighbour minima with pointer jumping, so paths shorten by powers; each round is
    written to the shared folder and the one before it removed. Hot ids are combined before the
    shuffle by the minimum. Raises if it has not settled after ``rounds`` (2^rounds is the path length).
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, f"{label}-links")
    now = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), f"{label}-labels")
    for _ in range(rounds):
        near = both.join(now.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        hop = now.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        step = (
            now.join(near, "a")
            .join(hop, "c")
            .select("a", F.least("m", "cc", "c").alias("c"), F.col("c").alias("was"))
        )
        nxt = stage(step, f"{label}-labels")
        moved = nxt.filter("c <> was").limit(1).count()
        discard(now)
        now = nxt.select("a", "c")
        if not moved:
            discard(both)
            return now.select(F.col("a").alias("id"), F.col("c").alias("component"))
    raise RuntimeError(f"{label}: links did not settle in {rounds} rounds")
