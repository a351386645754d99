"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set is its distinct word shingles; its sketch is the ``k`` smallest shingle hashes.
   Documents with equal sets form one class, which goes on as one node.
2. Inverted lists of retained values generate overlaps. Values are ordered by how many nodes retain
   them, rarest first, and only the rarest values of a node are listed: two sketches that share at
   least half their values meet in such a list (prefix filter), and common values make no lists.
   Nodes connected through lists form a block; this is bookkeeping, not yet a link.
3. Inside a block, overlaps of sketches, then the estimate from the union sketch, then the exact
   Jaccard value on the full sets decide. Blocks above ``tile`` shingles are cut into tiles of two
   parts, so every pair of a block still meets in one task. A task reports a spanning forest of its
   links, never the pairs.
4. Components of the links give each document the smallest doc_id it can reach.
"""

from __future__ import annotations

from itertools import pairwise
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, WordHashes, by_batch, components, ngram_hashes, utf8, words_of
from paceforge.session import discard, stage

_PAD = np.uint64((1 << 64) - 1)


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one shingle, an empty one none."""
    words = words_of(text.translate(LOWER)) if text else []
    return np.unique(ngram_hashes(hashes.of(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def _set_key(values: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(values.tobytes())


def _profile(n: int, k: int):
    hashes = WordHashes()

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, hashes, n) for t in batch.column("body").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": [_set_key(s) for s in sets],
            "sketch": pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    return rows


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def _union_estimate(own: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Share of the k smallest values of the two sketches together that both hold."""
    both = np.sort(np.hstack([np.broadcast_to(own, others.shape), others]), axis=1)
    real = both != _PAD
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    distinct = np.cumsum(real & ~again, axis=1)
    shared = (again & (distinct <= k)).sum(axis=1)
    return shared / np.minimum(distinct[:, -1], k)


def linked_pairs(sets: list[np.ndarray], part: np.ndarray | None, k: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``; with ``part``, of links between the two parts."""
    n = len(sets)
    if n < 2:
        return []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sketch = np.full((n, k), _PAD, np.uint64)
    for i, s in enumerate(sets):
        sketch[i, : min(k, len(s))] = s[:k]
    kept = np.minimum(sizes, k)
    # Inverted lists of the retained values: value -> rows.
    head = np.arange(len(ids)) - np.repeat(starts, sizes) < k
    value, row = ids[head], np.repeat(np.arange(n), sizes)[head]
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    begin = np.searchsorted(value, np.arange(ids.max() + 2))
    length = np.diff(begin)
    central = np.add.reduceat(np.where(head, length[ids], 0), starts)
    threshold = percent / 100
    margin = 5 * sqrt(threshold * (1 - threshold) / k)
    forest, links, mark = _Forest(n), [], np.zeros(ids.max() + 1, bool)
    for x in np.lexsort((np.arange(n), -central)).tolist():
        own = ids[starts[x] : starts[x] + kept[x]]
        overlap = np.bincount(np.concatenate([row[begin[v] : begin[v + 1]] for v in own]), minlength=n)
        near = (2 * overlap >= np.maximum(kept, kept[x])) & (forest.roots() != forest.root(x))
        near &= 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        if part is not None:
            near &= part != part[x]
        near = np.flatnonzero(near)
        near = near[_union_estimate(sketch[x], sketch[near], k) >= threshold - margin] if len(near) else near
        if not len(near):
            continue
        mine = ids[starts[x] : starts[x] + sizes[x]]
        mark[mine] = True
        for y in near.tolist():
            if forest.root(y) == forest.root(x):
                continue
            shared = int(np.count_nonzero(mark[ids[starts[y] : starts[y] + sizes[y]]]))
            if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                links.append((x, y))
                forest.up[forest.root(y)] = forest.root(x)
        mark[mine] = False
    return links


def _verify(n: int, k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        table = table.sort_by([(c, "ascending") for c in ("block", "i", "j", "side", "rep", "set_key")])
        place = np.stack([table.column(c).to_numpy() for c in ("block", "i", "j")], axis=1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        rep, side, keys = (table.column(c).to_numpy() for c in ("rep", "side", "set_key"))
        body = table.column("body")
        a, b = [], []
        for lo, hi in pairwise([0, *cuts.tolist(), len(place)]):
            sets = [shingle_set(t, hashes, n) for t in body.slice(lo, hi - lo).to_pylist()]
            # A doc_id may be repeated with another text; only the text of the class counts.
            own = [i for i, s in enumerate(sets) if _set_key(s) == keys[lo + i]]
            part = side[lo:hi][own] if place[lo, 1] != place[lo, 2] else None
            for x, y in linked_pairs([sets[i] for i in own], part, k, percent):
                a.append(int(rep[lo + own[x]]))
                b.append(int(rep[lo + own[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 80, shingle: int = 5, k: int = 64, tile: int = 400_000
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * shared >= percent * union`` of their shingle sets. component_id is
    the smallest doc_id reachable over links; kept is true where that is the document itself.

    Null, empty or blank text: an empty set, linked with nothing. Texts shorter than a shingle are one
    shingle as a whole. Null doc_id: linked with nothing, component_id null, kept. Repeated rows share
    a component. Other columns are ignored; an empty table gives no rows.

    The only step that is not exact is the sketch: a pair at the threshold is missed if its estimate
    falls five standard deviations short or its sketches share under half their values. For ``k`` of 64 each
    is below one in a million from 80 per cent on; the second grows to about one in ten thousand at 70 and
    one in a hundred at 60, where ``k`` should be raised. Below 60 per cent two sketches need not share half
    their values, so that is refused. Sets of up to ``k`` shingles are compared exactly throughout.
    """
    if percent < 60:
        raise ValueError("sketches can't propose pairs below 60 per cent")
    spark = docs.sparkSession
    source = docs.select("doc_id", utf8("text").alias("body"))
    id_type = dict(source.dtypes)["doc_id"]
    profile = stage(
        by_batch(source, _profile(shingle, k), f"doc_id {id_type}, n_shingles long, set_key string, sketch array<long>"),
        "near-profile",
    )
    classes = stage(
        profile.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").cast("long").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "near-classes",
    )
    retained = classes.select("node", F.explode("sketch").alias("v"))
    common = retained.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    listed = (
        retained.join(common, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("lists"))
    )
    kept = F.least(F.col("n"), F.lit(k))
    # Values that only one node holds come first in the order and use up their part of the prefix.
    room = kept - F.ceil(kept / 2) + 1 - (kept - F.size("lists"))
    postings = stage(
        listed.join(classes.select("node", "n"), "node")
        .select("node", room.cast("int").alias("room"), "lists")
        .filter("room > 0")
        .select("node", F.explode(F.slice("lists", F.lit(1), F.col("room"))).alias("e"))
        .select("node", F.col("e.v").alias("v")),
        "near-postings",
    )
    hubs = postings.groupBy("v").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub < most")
    edges = stage(
        postings.join(hubs.select("v", "hub"), "v").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(),
        "near-edges",
    )
    blocks = components(edges, "near-blocks")
    members = stage(
        blocks.select(F.col("id").alias("node"), F.col("component").alias("block")).join(
            classes.select("node", "rep", "set_key", "n"), "node"
        ),
        "near-members",
    )
    # Parts per block: a tile of two parts holds at most about ``tile`` shingles.
    sizes = members.groupBy("block").agg(F.sum("n").alias("total"))
    pieces = F.when(F.col("total") <= tile, F.lit(1)).otherwise(F.ceil(2 * F.col("total") / tile)).cast("int")
    sizes = stage(sizes.select("block", "total", pieces.alias("pieces")), "near-sizes")
    weight = sizes.agg(F.sum(F.col("total") * F.col("pieces"))).first()[0] or 0
    bins = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // (2 * tile)))
    part = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda o: F.struct(
            F.least(o, F.col("part")).alias("i"),
            F.greatest(o, F.col("part")).alias("j"),
            F.when(F.col("part") > o, F.lit(1)).otherwise(F.lit(0)).alias("side"),
        ),
    )
    assigned = (
        members.join(sizes.select("block", "pieces"), "block")
        .withColumn("part", part)
        .select("rep", "set_key", "block", F.explode(tiles).alias("at"))
        .select("rep", "set_key", "block", "at.i", "at.j", "at.side")
    )
    texts = source.withColumn("rep", F.col("doc_id").cast("long")).select("rep", "body")
    links = stage(
        texts.join(assigned, "rep")
        .withColumn("bin", F.pmod(F.xxhash64("block", "i", "j"), F.lit(bins)))
        .groupBy("bin")
        .applyInArrow(_verify(shingle, k, percent), "a long, b long"),
        "near-links",
    )
    found = components(links, "near-components")
    verdict = stage(
        classes.select("set_key", "rep")
        .join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("set_key", F.coalesce("component", "rep").alias("component")),
        "near-verdict",
    )
    for done in (postings, edges, members, sizes, links, classes):
        discard(done)
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id").cast("long")))
    return (
        profile.select("doc_id", "n_shingles", "set_key")
        .join(verdict, "set_key", "left")
        .select("doc_id", "n_shingles", linked.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
