"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words. Each window is represented by its anchor: the phrase of
``phrase`` words with the smallest hash in it (leftmost on ties), which depends on the window's words
alone. Equal windows therefore share an anchor, and about one phrase in ``(window - phrase) / 2`` is
an anchor, so phrases can be counted without listing every window.

1. Count how often each anchor phrase occurs; keep those of more than one document.
2. Cut the stretch of windows around every recurring anchor out of its text and send it to the shard
   of the anchor.
3. In a shard, confirm the windows that start in two documents, join consecutive ones into passages,
   compile the passages into one Aho-Corasick automaton over word numbers, and stream all stretches of
   the shard through it. A passage found in a document later than the owners of its windows covers
   words to remove. The automaton compares words, so hashes only propose.
4. Anchors at more than ``heavy`` places would make a shard grow with the corpus. Equal
   stretches of theirs are combined before the shuffle, the windows of what remains are counted one by
   one, and a join Spark can split hands the owners back to every text.

Equal texts are handled once: the smallest doc_id stands for all, the others repeat it as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from paceforge.llm.common import Tables, WordHashes, by_batch, ngram_hashes, text_key, utf8, words_of
from paceforge.session import discard, stage

#: Order of a row without doc_id: after all others.
LAST = (1 << 63) - 1
_SPANS = "array<struct<first: int, after: int>>"
_COVER = "t string, first int, after int"


def anchor_positions(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the position of its smallest, leftmost on ties."""
    n = len(grams) - span + 1
    if n < 1:
        return np.empty(0, np.int64)
    best, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        width += step
    return best[:n]


def _anchored(words: list[bytes], hashes: WordHashes, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, anchor position of each window) of a text."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = ngram_hashes(hashes.of(words), phrase)
    return grams, anchor_positions(grams, window - phrase + 1)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of consecutive true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _profile(window: int, phrase: int):
    hashes = WordHashes()

    def rows(batch: pa.RecordBatch) -> dict:
        n_words, sha, anchors = [], [], []
        for text in batch.column("body").to_pylist():
            words = words_of(text)
            grams, at = _anchored(words, hashes, window, phrase)
            n_words.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            anchors.append(grams[np.unique(at)].view(np.int64))
        return {
            "doc_id": batch.column("doc_id"),
            "t": batch.column("t"),
            "ord": batch.column("ord"),
            "n_words": pa.array(n_words, pa.int64()),
            "sha": sha,
            "anchors": pa.array(anchors, pa.list_(pa.int64())),
        }

    return rows


def _stretches(window: int, phrase: int):
    """Stretches of windows that share an anchor of the row's list ``light``; equal ones of a text once."""
    hashes = WordHashes()
    schema = pa.schema([("h", pa.int64()), ("ord", pa.int64()), ("t", pa.string()), ("first", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Tables) -> Tables:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for text, own, order, t in zip(*(batch.column(c).to_pylist() for c in ("body", "light", "ord", "t")), strict=True):
                words = words_of(text)
                grams, at = _anchored(words, hashes, window, phrase)
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
                ends = np.append(starts[1:], len(at))
                keys = grams[at[starts]].view(np.int64) if len(at) else at
                wanted = np.isin(keys, np.array(own, np.int64))
                places: dict[tuple[int, bytes], list[int]] = {}
                for key, s, e in zip(keys[wanted].tolist(), starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                    places.setdefault((key, b" ".join(words[s : e - 1 + window])), []).append(s)
                for (key, stretch), firsts in places.items():
                    for c, value in zip(schema.names, (key, order, t, firsts, stretch), strict=True):
                        out[c].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _hot_stretches(window: int, phrase: int):
    """Stretches whose anchor is in the row's list ``hot``, as hashes of their windows."""
    hashes = WordHashes()
    schema = pa.schema([("s", pa.string()), ("w", pa.list_(pa.int64())), ("ord", pa.int64()), ("t", pa.string()), ("first", pa.list_(pa.int32()))])

    def run(batches: Tables) -> Tables:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for text, own, order, t in zip(*(batch.column(c).to_pylist() for c in ("body", "hot", "ord", "t")), strict=True):
                words = words_of(text)
                grams, at = _anchored(words, hashes, window, phrase)
                whole = ngram_hashes(hashes.of(words), window).view(np.int64)
                starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                ends = np.append(starts[1:], len(at))
                wanted = np.isin(grams[at[starts]].view(np.int64), np.array(own, np.int64))
                places: dict[bytes, list[int]] = {}
                for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                    places.setdefault(whole[s:e].tobytes(), []).append(s)
                for listed, firsts in places.items():
                    row = (xxhash.xxh3_128_hexdigest(listed), np.frombuffer(listed, np.int64), order, t, firsts)
                    for c, value in zip(schema.names, row, strict=True):
                        out[c].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _passages(sequences: list[list[bytes]], lists: list[np.ndarray], least: list[int], most: list[int], window: int):
    """Confirmed passages of a shard as word numbers, each with the largest of its windows' owners.

    ``lists`` holds the window hashes of each distinct sequence, ``least`` and ``most`` the smallest and
    largest document that has the sequence. A document loses the windows whose owner is smaller, so the
    runs to remove change only where its order passes an owner; each such level gives its passages.
    """
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    every, holder = np.concatenate(lists), np.repeat(np.array(least, np.int64), sizes)
    by = np.lexsort((holder, every))
    fresh = np.concatenate(([True], every[by][1:] != every[by][:-1]))
    owner = np.empty(len(every), np.int64)
    owner[by] = holder[by][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    number: dict[bytes, int] = {}
    passages: dict[tuple[int, ...], int] = {}
    for i, (a, b) in enumerate(pairwise(np.concatenate(([0], np.cumsum(sizes))).tolist())):
        owners = owner[a:b]
        for level in np.unique(owners[owners < most[i]]).tolist():
            for s, e in _runs(owners <= level):
                key = tuple(number.setdefault(x, len(number) + 1) for x in sequences[i][s : e - 1 + window])
                known = int(owners[s:e].max())
                passages[key] = min(known, passages.get(key, known))
    return number, passages


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _locate(window: int):
    """Passages confirmed in a shard, and every place where a later document holds one.

    Near copies send the same words over and over, so each distinct sequence is streamed once and its
    matches serve all documents that hold it.
    """

    def run(table: pa.Table) -> pa.Table:
        order = table.column("ord").to_pylist()
        rows: dict[bytes, list[int]] = {}
        for i, words in enumerate(table.column("words").to_pylist()):
            rows.setdefault(words, []).append(i)
        sequences = [words.split() for words in rows]
        hashes = WordHashes(most=1 << 62)
        lists = [ngram_hashes(hashes.of(x), window) for x in sequences]
        held = [[order[i] for i in own] for own in rows.values()]
        number, passages = _passages(sequences, lists, [min(x) for x in held], [max(x) for x in held], window)
        found: dict[str, list] = {"t": [], "first": [], "after": []}
        if passages:
            machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, known in passages.items():
                machine.add_word(key, (len(key), known))
            machine.make_automaton()
            names, firsts = table.column("t").to_pylist(), table.column("first").to_pylist()
            for words, own in zip(sequences, rows.values(), strict=True):
                spans: dict[int, set[tuple[int, int]]] = {}
                for end, (length, known) in machine.iter(tuple(number.get(x, 0) for x in words)):
                    spans.setdefault(known, set()).add((end - length + 1, end + 1))
                levels, covers, so_far = sorted(spans), [], []
                for known in levels:
                    so_far = _joined([*so_far, *spans[known]])
                    covers.append(so_far)
                for i in own:
                    rank = bisect_left(levels, order[i])
                    for s, e in covers[rank - 1] if rank else ():
                        found["t"] += [names[i]] * len(firsts[i])
                        found["first"] += [at + s for at in firsts[i]]
                        found["after"] += [at + e for at in firsts[i]]
        return pa.table(
            {
                "t": pa.array(found["t"], pa.string()),
                "first": pa.array(found["first"], pa.int32()),
                "after": pa.array(found["after"], pa.int32()),
            }
        )

    return run


def _covered(n: int, covers: list[dict]) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    for c in covers:
        change[c["first"]] += 1
        change[c["after"]] -= 1
    return np.cumsum(change[:-1]) > 0


def _cut(batch: pa.RecordBatch) -> dict:
    removed, sha, spans = [], [], []
    for text, covers in zip(batch.column("body").to_pylist(), batch.column("covers").to_pylist(), strict=True):
        words = words_of(text)
        gone = _covered(len(words), covers)
        kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
        removed.append(int(gone.sum()))
        sha.append(hashlib.sha256(kept).hexdigest())
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans.append([{"first": int(x), "after": int(y)} for x, y in edges.reshape(-1, 2)])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
    return {"t": batch.column("t"), "n_cut": pa.array(removed, pa.int64()), "cut_sha": sha, "cuts": pa.array(spans, kind)}


@F.arrow_udf(BinaryType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, covers in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None:
            out.append(None)
            continue
        words = words_of(text)
        out.append(b" ".join([words[i] for i in np.flatnonzero(~_covered(len(words), covers))]))
    return pa.array(out, pa.binary())


def remove_repeated_phrases(
    docs: DataFrame, window: int = 50, phrase: int = 20, heavy: int = 2_000, shard_rows: int = 8_000
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, as :func:`repeated_spans` finds them."""
    found = repeated_spans(docs, window, phrase, heavy, shard_rows)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def cut_repeated_phrases(
    docs: DataFrame, window: int = 50, phrase: int = 20, heavy: int = 2_000, shard_rows: int = 8_000
) -> DataFrame:
    """``docs`` with all columns, the texts without their repeated phrases.

    A text that loses words is what is left of them, joined by one space; all others stay as they are.
    """
    found = repeated_spans(docs, window, phrase, heavy, shard_rows).filter("n_removed > 0")
    found = found.select(F.col("doc_id").alias("id"), "text_id", "spans").distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("own_id"), text_key().alias("own_text")
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_text") == F.col("text_id"))
    short = _without(F.when(F.col("spans").isNotNull(), utf8("doc.text")), F.coalesce("spans", F.array())).cast("string")
    return whole.join(found, same, "left").select(
        *(F.coalesce(short, "doc.text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns)
    )


def repeated_spans(
    docs: DataFrame, window: int = 50, phrase: int = 20, heavy: int = 2_000, shard_rows: int = 8_000
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, text_id and the removed spans of words.

    A word goes if a window that covers it also starts in a document with a smaller doc_id. All windows
    are judged on the input.

    Null or empty text: no words. Null doc_id: counts as larger than any other, so such rows lose what
    others hold and own nothing against them. Repeated rows (same doc_id) never remove each other's
    words. Texts shorter than the window keep all words. Other columns are ignored; an empty table gives
    no rows.

    heavy: anchors at more places than this are counted window by window. shard_rows: stretches per
    automaton, so an automaton holds at most about ``80 * shard_rows`` words.
    """
    spark = docs.sparkSession
    own = docs.select(
        "doc_id",
        F.coalesce(text_key(), F.lit("")).alias("t"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        utf8("text").alias("body"),
    )
    id_type = dict(own.dtypes)["doc_id"]
    profile = stage(
        by_batch(own, _profile(window, phrase), f"doc_id {id_type}, t string, ord long, n_words long, sha string, anchors array<long>"),
        "phrase-profile",
    )
    texts = stage(
        profile.groupBy("t").agg(F.min("ord").alias("ord"), F.first("anchors").alias("anchors")),
        "phrase-texts",
    )
    counted = texts.select("ord", F.explode("anchors").alias("h")).groupBy("h")
    recurring = stage(
        counted.agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("least"), F.max("ord").alias("most"))
        .filter("least < most")
        .select("h", "n"),
        "phrase-recurring",
    )
    places = texts.select("t", "ord", F.explode(F.array_distinct("anchors")).alias("h"))
    light = recurring.agg(F.sum(F.when(F.col("n") <= heavy, F.col("n")))).first()[0] or 0
    wanted = (
        places.join(recurring, "h")
        .groupBy("t", "ord")
        .agg(
            F.collect_list(F.when(F.col("n") <= heavy, F.col("h"))).alias("light"),
            F.collect_list(F.when(F.col("n") > heavy, F.col("h"))).alias("hot"),
        )
    )
    repeats = stage(own.select("t", "ord", "body").join(wanted, ["t", "ord"]), "phrase-repeats")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(2 * parts, -(-light // shard_rows))
    stretches = repeats.filter("size(light) > 0").mapInArrow(
        _stretches(window, phrase), "h long, ord long, t string, first array<int>, words binary"
    )
    located = (
        stretches.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_locate(window), _COVER)
    )
    hot = stage(
        repeats.filter("size(hot) > 0").mapInArrow(
            _hot_stretches(window, phrase), "s string, w array<long>, ord long, t string, first array<int>"
        ),
        "phrase-hot",
    )
    kinds = hot.groupBy("s", "w").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    single = stage(kinds.select("s", "least", "most", F.posexplode("w").alias("at", "w")), "phrase-windows")
    owners = stage(
        single.groupBy("w").agg(F.min("least").alias("owner"), F.max("most").alias("most")).filter("owner < most").select("w", "owner"),
        "phrase-owners",
    )
    marks = single.join(owners, "w").groupBy("s").agg(F.collect_list(F.struct("at", "owner")).alias("marks"))
    here = F.filter("marks", lambda m: m["owner"] < F.col("ord"))
    listed = hot.join(marks, "s").select(
        "t",
        F.flatten(
            F.transform(
                "first",
                lambda f: F.transform(
                    here, lambda m: F.struct((f + m["at"]).alias("first"), (f + m["at"] + window).alias("after"))
                ),
            )
        ).alias("spans"),
    )
    spans = located.select("t", F.array(F.struct("first", "after")).alias("spans")).union(listed)
    covers = spans.groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("covers"))
    cut = by_batch(
        repeats.select("t", "body").join(covers, "t"), _cut, f"t string, n_cut long, cut_sha string, cuts {_SPANS}"
    ).groupBy("t").agg(F.first(F.struct("n_cut", "cut_sha", "cuts")).alias("cut"))
    cut = cut.select("t", "cut.*")
    verdict = stage(
        texts.select("t", F.col("ord").alias("least")).join(cut, "t", "left"), "phrase-verdict"
    )
    for done in (hot, single, owners, recurring):
        discard(done)
    copy = (F.col("ord") > F.col("least")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("after")))
    return (
        profile.select("doc_id", "t", "ord", "n_words", "sha")
        .join(verdict, "t", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.col("t").alias("text_id"),
            F.when(copy, whole).otherwise(F.coalesce("cuts", F.array())).alias("spans"),
        )
    )
