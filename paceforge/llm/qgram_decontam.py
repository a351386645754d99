"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs with at most e edits keeps at least ``m - q + 1 - q * e`` of its
q-grams, all within e diagonals of each other (diagonal: position in the document less position in the
passage). Per document the q-grams shared with every passage are counted in diagonal bands 2 (e + 1)
wide that overlap by half, so each such occurrence falls into one band as a whole. Bands that meet the
bound are verified by an alignment limited to the diagonals of the band.

Texts are compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import Tables, ngram_hashes
from paceforge.session import stage

_BITS = 22


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def banded_alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``text`` with diagonals in [low, high].

    The item is aligned as a whole, the text in part. Column b of a row is text position i + low + b.
    """
    width = high - low + 1
    worst = budget + 1
    ramp = np.arange(width)
    at = low + ramp
    cost = np.where((at >= 0) & (at <= len(text)), 0, worst).astype(np.int64)
    start = at.copy()
    padded = np.full(len(text) + 2 * width + len(item) + abs(low) + 2, 0xFFFFFFFF, np.uint32)
    shift = max(0, -low) + 1
    padded[shift : shift + len(text)] = text
    for i, c in enumerate(item.tolist()):
        here = low + i + ramp  # text position read by a step along the diagonal
        letters = padded[shift + low + i : shift + low + i + width]
        inside = (here >= 0) & (here < len(text))
        diagonal = cost + np.where(inside & (letters == c), 0, np.where(inside, 1, worst))
        # Leaving out a letter of the item moves one column to the left.
        skip = np.append(cost[1:], worst) + 1
        origin = np.where(skip < diagonal, np.append(start[1:], 0), start)
        best = np.minimum(diagonal, skip)
        # A letter of the text that the item lacks: from any column to the left, one edit a column.
        least = np.minimum.accumulate(best - ramp)
        source = np.maximum.accumulate(np.where(best - ramp == least, ramp, 0))
        cost = np.minimum(best, least + ramp)
        start = np.where(least + ramp < best, origin[source], origin)
        end = here + 1
        cost = np.where((end >= 0) & (end <= len(text)), np.minimum(cost, worst), worst)
        if cost.min() >= worst:
            return None
    b = int(np.argmin(cost))
    return int(cost[b]), int(start[b]), len(item) + low + b


class PassageIndex:
    """Passages with their q-grams inverted; built in the task from the passages' texts."""

    def __init__(self, items: Iterable[tuple[int, str]], q: int, edit_percent: int):
        self.q = q
        self.ids, self.texts, self.budget, self.bound = [], [], [], []
        self.short: list[tuple[int, str]] = []
        hashes, owners, offsets = [], [], []
        for item, text in items:
            m = len(text)
            if m < q:
                self.short.append((item, text))
                continue
            e = min(m * edit_percent // 100, (m - q) // q)  # the bound stays at least one
            grams = ngram_hashes(_codes(text).astype(np.uint64) + np.uint64(1), q)
            hashes.append(grams)
            owners.append(np.full(len(grams), len(self.ids)))
            offsets.append(np.arange(len(grams)))
            self.ids.append(item)
            self.texts.append(text)
            self.budget.append(e)
            self.bound.append(m - q + 1 - q * e)
        empty = np.empty(0, np.int64)
        keys = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.begin = np.append(first, len(keys))
        self.owner = np.concatenate(owners)[order] if owners else empty
        self.offset = np.concatenate(offsets)[order] if offsets else empty
        self.step = np.array(self.budget, np.int64) + 1
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _BITS)] = True

    def _bands(self, codes: np.ndarray) -> dict[int, list[int]]:
        """Passage -> bands that hold enough of its q-grams."""
        grams = ngram_hashes(codes.astype(np.uint64) + np.uint64(1), self.q)
        at = np.flatnonzero(self.maybe[grams >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.keys):
            return {}
        where = np.searchsorted(self.keys, grams[at])
        where[where == len(self.keys)] = 0
        true = self.keys[where] == grams[at]
        at, where = at[true], where[true]
        n = self.begin[where + 1] - self.begin[where]
        if not len(at):
            return {}
        spot = np.repeat(self.begin[where] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner = self.owner[spot]
        diagonal = np.repeat(at, n) - self.offset[spot]
        band = diagonal // self.step[owner]
        found: dict[int, list[int]] = {}
        pairs = np.concatenate([np.stack([owner, band], 1), np.stack([owner, band - 1], 1)])
        pairs, count = np.unique(pairs, axis=0, return_counts=True)
        for (i, b), c in zip(pairs.tolist(), count.tolist(), strict=True):
            if c >= self.bound[i]:
                found.setdefault(i, []).append(b)
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of every passage in a normalised text, its best place each."""
        out = []
        padded = f" {text} "
        for item, short in self.short:
            at = padded.find(f" {short} ")
            if at >= 0:
                out.append((item, at, at + len(short), 0))
        if len(text) < self.q:
            return out
        codes = _codes(text)
        for i, bands in self._bands(codes).items():
            item, e = self.texts[i], self.budget[i]
            best: tuple[int, int, int] | None = None
            lo = bands[0]
            for b, nxt in zip(bands, [*bands[1:], None], strict=True):
                if nxt is not None and nxt <= b + 2:
                    continue
                low, high = lo * (e + 1) - e, (b + 2) * (e + 1) - 1 + e
                lo = nxt if nxt is not None else lo
                at = text.find(item, max(0, low), max(0, high + len(item)) + 1)
                if at >= 0:
                    hit = (0, at, at + len(item))
                else:
                    hit = banded_alignment(_codes(item), codes, low, high, e)
                if hit is not None and (best is None or hit < best):
                    best = hit
            if best is not None:
                out.append((self.ids[i], best[1], best[2], best[0]))
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    q: int = 10,
    edit_percent: int = 8,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits, item_chars) for every passage of ``benchmark`` that a
    document holds with at most ``edit_percent`` per cent of its characters edited.

    start and end are positions in the normalised document, of the place with the fewest edits (the first
    of several). The budget of passages under about ``2 * q`` characters is lowered until the lemma still
    asks for a q-gram; passages shorter than q must stand there word for word.

    Null or blank texts and passages match nothing. Null ids are carried as null. Repeated documents and
    passages, and item_ids with several texts, give a row each. Other columns are ignored; empty tables give
    no rows.

    The benchmark is the stated query set. It goes to the tasks in blocks of about ``block_chars``
    characters, one scan of the documents each, so what is sent at once has a bound. With more than one
    block each scan's rows are written before the next block is read, so the driver holds one block.
    """
    own = docs.select("doc_id", "text")
    id_type, item_type = dict(own.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", "text").filter("text is not null")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    schema = f"doc_id {id_type}, item_id {item_type}, start int, end int, edits int, item_chars int"
    result = None
    for block in range(max(1, blocks)):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == block)
        passages = [(r["item_id"], t) for r in part.collect() if (t := normalise(r["text"]))]
        found = own.mapInArrow(_search(passages, q, edit_percent, own.schema["doc_id"], benchmark.schema["item_id"]), schema)
        found = stage(found, "leaks") if blocks > 1 else found
        result = found if result is None else result.union(found)
    return result


def _search(passages: list[tuple[int, str]], q: int, edit_percent: int, doc_field, item_field):
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type, item_type = to_arrow_type(doc_field.dataType), to_arrow_type(item_field.dataType)

    def run(batches: Tables) -> Tables:
        index = PassageIndex(list(enumerate(t for _, t in passages)), q, edit_percent)
        for batch in batches:
            rows = [
                (doc, passages[item][0], s, e, edits, len(passages[item][1]))
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                if text
                for item, s, e, edits in index.find(normalise(text))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [doc_type, item_type] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "start", "end", "edits", "item_chars"],
            )

    return run
