"""Importance resampling towards a target set, with segments counted once.

Features are runs of one to three words, hashed to buckets by CRC-32. Line breaks separate words, so a text
falls into lines; equal lines are grouped (combined before the shuffle) and the features inside a line are
computed once for each distinct line, then multiplied by its occurrences. Runs that cross line ends need
only the two words at either side of each end; they are added document by document. The CRCs of runs follow
from those of their words, as appending bytes is linear.

The counts of all documents and of the target texts give every bucket a gain; a line's weight is looked up
once and joined to its occurrences. Lines that make up over a thousandth of all occurrences are at most a
thousand and go by broadcast, so no join key is hot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, Tables, text_key, utf8
from paceforge.operators.numbering import number_sorted
from paceforge.session import stage

#: Bytes of words (after lower-casing A-Z); all others become a space, line feeds stay.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b if (b := LOWER[i]) in _WORD or b == 10 else 32 for i in range(256))
#: CRC-32 polynomial, reversed (fixed value).
_POLYNOMIAL = 0xEDB88320
#: A line above one part in so many of all occurrences goes by broadcast.
HOT_PARTS = 1_000


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


class Shifts:
    """CRC-32 of a message followed by n zero bytes, for arrays of checksums and lengths."""

    def __init__(self, direct: int = 48):
        step = _byte_table()
        byte = np.arange(256, dtype=np.uint32)
        table = np.stack([byte << np.uint32(8 * j) for j in range(4)])
        tables = [table]
        for _ in range(direct):
            table = step[table & 255] ^ (table >> np.uint32(8))
            tables.append(table)
        self.direct, self.tables = direct, np.stack(tables)
        self.powers = [self.tables[1]]  # 2^k zero bytes
        for _ in range(31):
            self.powers.append(self._apply(self.powers[-1], self.powers[-1]))

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = table[0][crc & 255]
        for j in range(1, 4):
            out = out ^ table[j][(crc >> np.uint32(8 * j)) & 255]
        return out

    def __call__(self, crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        short = np.minimum(zeros, self.direct)
        out = self.tables[short, 0, crc & 255]
        for j in range(1, 4):
            out ^= self.tables[short, j, (crc >> np.uint32(8 * j)) & 255]
        for i in np.flatnonzero(zeros > self.direct):  # rare: words of over 48 bytes
            value, left = crc[i : i + 1], int(zeros[i])
            for k in range(left.bit_length()):
                if left >> k & 1:
                    value = self._apply(self.powers[k], value)
            out[i] = value[0]
        return out


class Checksums(dict):
    """CRC-32 and length of each word seen, packed; emptied when it grows past ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) | len(word) << 32
        return value

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32


_SPACE_CRC = np.uint32(zlib.crc32(b" "))


class Runs:
    """Buckets of the runs of one, two and three words in word sequences."""

    def __init__(self, buckets: int):
        self.buckets, self.shift, self.words = buckets, Shifts(), Checksums()

    def of(self, words: list[bytes], joined: np.ndarray, crossing: np.ndarray | None = None):
        """Buckets in order of the first word, and how many start at each word.

        ``joined[i]``: word i + 1 follows word i. With ``crossing`` (a line number per word) only runs over
        more than one line count.
        """
        crc, size = self.words.of(words)
        n = len(words)
        spaced = self.shift(np.full(n, _SPACE_CRC), size) ^ crc
        two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        valid = np.zeros((n, 3), bool)
        valid[:, 0] = crossing is None
        if n > 1:
            two[:-1] = self.shift(crc[:-1], size[1:] + 1) ^ spaced[1:]
            valid[:-1, 1] = joined[: n - 1] & (True if crossing is None else crossing[:-1] != crossing[1:])
        if n > 2:
            three[:-2] = self.shift(two[:-2], size[2:] + 1) ^ spaced[2:]
            over = True if crossing is None else crossing[:-2] != crossing[2:]
            valid[:-2, 2] = joined[: n - 2] & joined[1 : n - 1] & over
        all_runs = np.stack([crc, two, three], axis=1) % np.uint32(self.buckets)
        return all_runs[valid], valid.sum(axis=1)


def _width(buckets: int) -> str:
    """Type of stored bucket numbers, the smallest that holds them."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _binary(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """One binary value per count: the next ``count`` values."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    offsets *= np.dtype(kind).itemsize
    data = pa.py_buffer(np.ascontiguousarray(values, kind).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


def line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _distinct_lines(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """key, n, runs: the buckets of every distinct line that has a word."""
    lines = docs.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))

    def run(batches: Tables) -> Tables:
        runs = Runs(buckets)
        for batch in batches:
            keys, n, sizes, words = [], [], [], []
            for line, count in zip(batch.column("line").to_pylist(), batch.column("n").to_pylist()):
                if found := line.translate(_FOLD).split():
                    keys.append(line_key(line))
                    n.append(count)
                    sizes.append(len(found))
                    words += found
            if not words:
                continue
            ends = np.cumsum(sizes)
            joined = np.ones(len(words), bool)
            joined[ends - 1] = False
            values, per_word = runs.of(words, joined)
            counts = np.add.reduceat(per_word, ends - sizes)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(keys, pa.binary()), "n": pa.array(n, pa.int64()), "runs": _binary(values, counts, _width(buckets))}
            )

    return lines.select(utf8("line").alias("line"), "n").mapInArrow(run, "key binary, n long, runs binary")


def _measured(docs: DataFrame, text: str, buckets: int, *kept: Column) -> DataFrame:
    """Per document: words, the buckets of runs over line ends, and the keys of its lines."""
    schema = docs.select(*kept).schema

    def run(batches: Tables) -> Tables:
        runs = Runs(buckets)
        for batch in batches:
            keys, total, words, line, doc, follows = [], [], [], [], [], []
            at = 0
            for d, value in enumerate(batch.column("_text").to_pylist()):
                mine, size = [], 0
                if value:
                    for raw in value.split(b"\n"):
                        found = raw.translate(_FOLD).split()
                        if not found:
                            continue
                        mine.append(line_key(raw))
                        size += len(found)
                        at += 1
                        if len(found) > 4:  # only two words at either end can cross
                            found = found[:2] + found[-2:]
                            follows += (True, False, True, True)
                        else:
                            follows += (True,) * len(found)
                        words += found
                        line += (at,) * len(found)
                        doc += (d,) * len(found)
                keys.append(mine)
                total.append(size)
            counts = np.zeros(batch.num_rows, np.int64)
            values = np.zeros(0, np.uint32)
            if words:
                doc_of = np.array(doc)
                joined = np.array(follows)
                joined[:-1] &= doc_of[1:] == doc_of[:-1]
                values, per_word = runs.of(words, joined, np.array(line))
                counts = np.bincount(doc_of, weights=per_word, minlength=batch.num_rows).astype(np.int64)
            columns = {f.name: batch.column(f.name) for f in schema}
            columns |= {"words": pa.array(total, pa.int64()), "runs": _binary(values, counts, _width(buckets))}
            yield pa.RecordBatch.from_pydict(columns | {"keys": pa.array(keys, pa.list_(pa.binary()))})

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["words long", "runs binary", "keys array<binary>"])
    return docs.select(*kept, utf8(text).alias("_text")).mapInArrow(run, out)


def _bucket_counts(counted: DataFrame, buckets: int) -> np.ndarray:
    """Sum of n over all runs per bucket; one row per bucket and task reaches the shuffle."""

    def run(batches: Tables) -> Tables:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, sizes = _values(batch.column("runs"), _width(buckets))
            times = np.repeat(batch.column("n").to_numpy().astype(np.float64), sizes)
            total += np.bincount(data, weights=times, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    sums = counted.select("runs", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def _values(runs: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    sizes = pa.compute.binary_length(runs).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(runs.to_pylist()), kind).astype(np.int64), sizes


def _weights(df: DataFrame, gains: np.ndarray, *kept: str) -> DataFrame:
    """The kept columns and ``w``, the sum of gains over the runs."""
    fields = [f for f in df.schema if f.name in kept]

    def run(batches: Tables) -> Tables:
        for batch in batches:
            data, sizes = _values(batch.column("runs"), _width(len(gains)))
            sums = np.concatenate([[0], np.cumsum(gains[data])])
            ends = np.cumsum(sizes)
            columns = {f.name: batch.column(f.name) for f in fields}
            yield pa.RecordBatch.from_pydict(columns | {"w": pa.array(sums[ends] - sums[ends - sizes], pa.int64())})

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["w long"])
    return df.select(*[f.name for f in fields], "runs").mapInArrow(run, out)


def bucket_gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed target and corpus frequencies."""
    b = len(here)
    s_all, t_all = float(here.sum() + b), float(target.sum() + b)
    ratio = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(here.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(
    docs: DataFrame,
    targets: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    buckets: int = 10_000,
    percent: int = 5,
    least_words: int = 20,
    seed: str = "42",
) -> DataFrame:
    """Importance weight, noisy score and draw of every document: key, n_features, weight, score, rank, n_words, text_id.

    weight sums the gains of all runs of one to three words (none: 0). score adds Gumbel noise that
    depends on ``seed`` and the key alone. Of the N documents with at least ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller key; the others have no rank.

    A null or empty text has no words. A document without a key has a weight but no score and is never
    drawn, though it counts towards N. Every row of a repeated key is a document of its own with the same
    noise. Without target texts all gains come from the corpus alone; an empty table gives no rows. Other
    columns are ignored.
    """

    def counts(table: DataFrame, column: str, *kept: Column) -> tuple[DataFrame, DataFrame]:
        rows = table.select(*kept, F.col(column).alias("_t"))
        measured = _measured(rows, "_t", buckets, *[F.col(f"`{c}`") for c in rows.columns[:-1]])
        measured = measured.withColumn("row", F.monotonically_increasing_id())
        return stage(measured, "runs"), stage(_distinct_lines(rows, "_t", buckets), "lines", compression="zstd")

    def all_counts(measured: DataFrame, lines: DataFrame) -> np.ndarray:
        both = lines.select("runs", "n").unionByName(measured.select("runs", F.lit(1).cast("long").alias("n")))
        return _bucket_counts(both, buckets)

    here, lines = counts(docs, text, F.col(key).alias("_id"), text_key(text).alias("text_id"))
    there, target_lines = counts(targets, "text")
    gains = bucket_gains(all_counts(here, lines), all_counts(there, target_lines))

    line_weights = stage(_weights(lines, gains, "key", "n"), "line-weights")
    places = line_weights.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PARTS > places
    hot_lines = F.broadcast(line_weights.filter(hot).select("key", "w"))  # fewer than HOT_PARTS rows
    spread = here.select("row", F.explode("keys").alias("key"))
    common_part = spread.join(hot_lines, "key").select("row", "w")
    rest = spread.join(hot_lines.select("key"), "key", "left_anti").join(line_weights.filter(~hot).select("key", "w"), "key")
    blank = [F.lit(None).cast(here.schema[c].dataType).alias(c) for c in ("_id", "text_id", "words")]
    own = _weights(here, gains, "_id", "text_id", "words", "row").select("row", "w", "_id", "text_id", "words")
    parts = own.unionByName(common_part.unionByName(rest.select("row", "w")).select("row", "w", *blank))
    summed = parts.groupBy("row").agg(
        F.sum("w").alias("weight"), F.max("_id").alias("_id"), F.max("text_id").alias("text_id"), F.max("words").alias("n_words")
    )

    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((hashed.cast("double") + 0.5) / 4294967296)))
    n = F.col("n_words")
    features = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    scored = stage(summed.select("*", features.alias("n_features"), (F.col("weight") + noise).alias("score")), "scored")
    able = F.col("n_words") >= least_words
    draw = percent * scored.filter(able).count() // 100
    able = able & F.col("score").isNotNull()
    ordered = number_sorted(scored.filter(able).withColumn("_down", -F.col("score")), ["_down", "_id", "n_features", "row"], "_rank", "draw")
    drawn = ordered.withColumn("rank", F.when(F.col("_rank") <= draw, F.col("_rank"))).drop("_down", "_rank")
    out = drawn.unionByName(scored.filter(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("_id").alias(key), "n_features", "weight", "score", "rank", "n_words", "text_id")


def resample(docs: DataFrame, targets: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; rows equal in key and text are drawn together."""
    chosen = weigh(docs, targets, text, key, **options).filter("rank IS NOT NULL")
    chosen = chosen.select(F.col(key).alias("key"), "text_id").distinct().alias("drawn")
    same = F.col(f"d.{key}").eqNullSafe(F.col("drawn.key")) & text_key(f"d.{text}").eqNullSafe(F.col("drawn.text_id"))
    return docs.alias("d").join(chosen, same, "left_semi")
