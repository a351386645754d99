"""Quality rules with cross-document line frequency.

Each document is read once and reduced to its base counts, the hashes of its distinct normalised lines
(ASCII lower case, runs of white space as one space) and a signature, the least hashes of its three-word
windows under sixteen functions. Copies must not turn their own lines into boilerplate, so a line is counted
by families: of a host's documents, those that agree with an earlier one in at least half of the signature,
and there with the earliest of its sharers, are of its family; equal texts are one document anyway. Lines in
more families than the host's limit are removed, and a document that keeps too small a part of its words is
rejected. ``line_frequency_rules`` gives the verdicts, ``remove_frequent_lines`` the kept documents without
those lines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from paceforge.llm.common import LOWER, WordHashes, by_batch, join_hot, ngram_hashes, text_key, utf8, words_of
from paceforge.session import discard, stage

_SYMBOLS = b"#*$%&|<>"
_LINES = "array<struct<h: bigint, words: bigint>>"
#: Odd factors: of the words of a window, and one for each place of a signature.
WINDOW_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SIGNATURE_FACTORS = tuple(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(16))
#: Places of the signature that must agree.
AGREEING = 8
_LAST = (1 << 63) - 1


class Md5Words(WordHashes):
    """The first 60 bits of a word's MD5, which SQL can compute as well."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int(hashlib.md5(word).hexdigest()[:15], 16)
        return value


def signature(words: list[bytes], hashes: Md5Words) -> list[int]:
    """Least hashes of the three-word windows, 63 bits each; none for fewer than three words."""
    h = hashes.of(words)
    if len(h) < 3:
        return []
    a, b, c = (np.uint64(f) for f in WINDOW_FACTORS)
    grams = np.unique(h[:-2] * a + h[1:-1] * b + h[2:] * c)
    return [int((grams * np.uint64(f)).min()) >> 1 for f in SIGNATURE_FACTORS]


def _line_hash(words: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - ((h >> 63) << 64)


def line_words(text: bytes) -> dict[int, int]:
    """Hash of each normalised line that has a word, with the words of all its copies in the text."""
    out: dict[int, int] = {}
    for line in text.translate(LOWER).split(b"\n"):
        if words := line.split():
            h = _line_hash(words)
            out[h] = out.get(h, 0) + len(words)
    return out


def without_lines(text: bytes, hashes: set[int]) -> bytes:
    """The text without the lines whose normalised form has one of the hashes; the others stay as they are."""
    lines = ((line, line.translate(LOWER).split()) for line in text.split(b"\n"))
    return b"\n".join(line for line, words in lines if not words or _line_hash(words) not in hashes)


@F.arrow_udf(BinaryType())
def _shortened(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    pairs = zip(texts.to_pylist(), hashes.to_pylist(), strict=True)
    return pa.array([None if t is None else without_lines(t, set(h)) for t, h in pairs], pa.binary())


def _counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 3:
        grams = ngram_hashes(hashes.of(words), 3)
        _, inverse, n = np.unique(grams, return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        covered = np.zeros(len(words), bool)
        for o in range(3):
            covered[o : o + len(grams)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _profile():
    hashes, md5 = WordHashes(), Md5Words()

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in batch.column("body").to_pylist()]
        counts = np.array([_counts(t, hashes) for t in texts], np.int64).reshape(-1, 5)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        lines = [[{"h": h, "words": n} for h, n in line_words(t).items()] for t in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "host": batch.column("host"),
            "t": batch.column("t"),
            **{c: counts[:, i] for i, c in enumerate(names)},
            "lines": pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))),
            "signature": pa.array([signature(words_of(t.translate(LOWER)), md5) for t in texts], pa.list_(pa.int64())),
        }

    return rows


def _host(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def line_frequency_rules(
    docs: DataFrame,
    host: str = "source",
    limit_docs: int = 20,
    limit_percent: int = 5,
    limit_any: int = 200,
    least_left_percent: int = 30,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, host, text_id, n_removed_words.

    A line of a host is removed if it stands in more than ``limit_docs`` documents and in more than
    ``limit_percent`` per cent of the host's, or in more than ``limit_any`` whatever the host's size; a
    family of copies counts as one document. A document is kept if it passes the base rules (50 words; at
    most half of them in repeated three-word windows) and at least ``least_left_percent`` per cent of its
    words remain.

    Null or empty text: no words, fails the base rules. Null host: the host ''. Repeated rows are judged
    alike and count as one document. Rows without doc_id are judged by their text. Other columns are
    ignored; an empty table gives no rows.
    """
    return _judged(docs, host, limit_docs, limit_percent, limit_any, least_left_percent).drop("removed")


def remove_frequent_lines(
    docs: DataFrame,
    host: str = "source",
    limit_docs: int = 20,
    limit_percent: int = 5,
    limit_any: int = 200,
    least_left_percent: int = 30,
) -> DataFrame:
    """The rows of ``docs`` that ``line_frequency_rules`` keeps, their text without their host's frequent lines.

    Lines that stay, blank ones too, are unchanged. All columns pass through, whatever their names.
    """
    judged = _judged(docs, host, limit_docs, limit_percent, limit_any, least_left_percent)
    passed = judged.filter("kept").select(F.col("doc_id").alias("id"), "host", "text_id", "removed").distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("own_id"), _host(host).alias("own_host"), text_key().alias("own_text"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_host") == F.col("host")) & (F.col("own_text") == F.col("text_id"))
    # Only texts that lose a line go through Python.
    short = _shortened(F.when(F.col("removed").isNotNull(), utf8("doc.text")), "removed").cast("string")
    return whole.join(passed, same).select(
        *(F.coalesce(short, "doc.text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns)
    )


def _families(texts: DataFrame) -> DataFrame:
    """(host, t, family) of the texts that are not the first of their family.

    Texts of a host that share a hash at a place of the signature meet at the earliest of them, by least
    doc_id and text. A text belongs to the one it meets at AGREEING places or more.
    """
    place = F.struct(F.coalesce("rep", F.lit(_LAST)).alias("rep"), F.col("t")).alias("place")
    seen = texts.select("host", "t", place, F.posexplode("signature").alias("j", "v"))
    meeting = seen.groupBy("host", "j", "v").agg(F.min("place").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = join_hot(seen, stage(meeting, "line-meetings"), ["host", "j", "v"], "n", len(SIGNATURE_FACTORS))
    agreed = met.filter("place <> lead").groupBy("host", "t", "lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= AGREEING)
    return agreed.groupBy("host", "t").agg(F.min("lead").getField("t").alias("family"))


def _judged(
    docs: DataFrame, host: str, limit_docs: int, limit_percent: int, limit_any: int, least_left_percent: int
) -> DataFrame:
    """The columns of ``line_frequency_rules`` and the hashes of the removed lines (null: none)."""
    own = docs.select(
        "doc_id",
        _host(host).alias("host"),
        F.coalesce(text_key(), F.lit("")).alias("t"),
        utf8("text").alias("body"),
    )
    id_type = dict(own.dtypes)["doc_id"]
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    profile = stage(
        by_batch(
            own, _profile(), f"doc_id {id_type}, host string, t string, {longs}, lines {_LINES}, signature array<long>"
        ),
        "line-profile",
    )
    texts = profile.groupBy("host", "t").agg(
        F.first("lines").alias("lines"), F.first("signature").alias("signature"), F.min(F.col("doc_id").cast("long")).alias("rep")
    )
    texts = stage(texts, "line-texts")
    texts = texts.join(_families(texts), ["host", "t"], "left").select("host", "t", "lines", F.coalesce("family", "t").alias("family"))
    texts = stage(texts, "line-families")
    limits = texts.select("host", "family").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("families"))
    lines = texts.select("host", "t", "family", F.explode("lines").alias("e")).select("host", "t", "family", "e.h", "e.words")
    # few lines stand in so many texts; only those are counted by family
    common = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit_docs).select("host", "h")
    common = stage(common, "line-common")
    counted = lines.join(common, ["host", "h"]).select("host", "h", "family").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = (F.col("n") > limit_docs) & ((100 * F.col("n") > limit_percent * F.col("families")) | (F.col("n") > limit_any))
    frequent = stage(counted.join(limits, "host").filter(often).select("host", "h"), "line-frequent")
    removed = stage(
        lines.join(frequent, ["host", "h"])
        .groupBy("host", "t")
        .agg(F.sum("words").alias("n_removed_words"), F.collect_list("h").alias("removed")),
        "line-removed",
    )
    discard(texts)
    discard(common)
    discard(frequent)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    depleted = 100 * (F.col("n_words") - gone) < least_left_percent * F.col("n_words")
    return (
        profile.drop("lines", "signature")
        .join(removed, ["host", "t"], "left")
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & ~depleted).alias("kept"),
            "host",
            F.col("t").alias("text_id"),
            gone.alias("n_removed_words"),
            "removed",
        )
    )
