"""Phrase, near-duplicate and line operators against plain versions, on edge rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_rows import empty, frame, prose, rows

from paceforge.llm import common, line_runs, near_dup, phrase_dedup

LAST = 1 << 62


def plain_phrases(table, w):
    first = {}
    for d, words in table:
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            first[key] = min(d, first.get(key, LAST))
    out = []
    for d, words in table:
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy", [2_000, 1])
def test_phrases(spark, heavy):
    got = phrase_dedup.remove_repeated_phrases(frame(spark), heavy=heavy).collect()
    table = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows()]
    assert sorted((LAST if r[0] is None else r[0], *r[1:]) for r in got) == plain_phrases(table, 50)
    assert sum(r["n_removed"] for r in got) > 500


def test_texts_without_their_phrases(spark):
    docs = frame(spark)
    out = phrase_dedup.cut_repeated_phrases(docs)
    assert out.columns == docs.columns
    table = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows()]
    want = {(d, n): (cut, sha) for d, n, cut, sha in plain_phrases(table, 50)}
    spans = phrase_dedup.repeated_spans(docs).collect()
    assert all(sum(s["after"] - s["first"] for s in r["spans"]) == r["n_removed"] for r in spans)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else LAST, " ".join((r["text"] or "").encode().decode().split())) for r in out.collect())
    kept = sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in got)
    assert kept == sorted(sha for _, _, _, sha in plain_phrases(table, 50)) and len(want) > 10
    same = {r["doc_id"]: r["text"] for r in out.filter("doc_id in (5, 6, 7, 15)").collect()}
    assert same == {r[0]: r[1] for r in rows() if r[0] in same}


def test_phrases_of_other_lengths(spark):
    got = phrase_dedup.remove_repeated_phrases(frame(spark), window=12, phrase=5, shard_rows=3).collect()
    table = [(LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows()]
    assert sorted((LAST if r[0] is None else r[0], *r[1:]) for r in got) == plain_phrases(table, 12)


@pytest.mark.parametrize("heavy", [2_000, 40])
def test_phrases_of_near_copies_and_repeated_lines(spark, heavy):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 60, 90)]
    table = []
    for d in rng.permutation(60).tolist():
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 4)).tolist():
            words[at] = f"x{rng.integers(0, 5)}"
        table.append((d, " ".join(words[: rng.integers(10, 91)] * int(rng.integers(1, 4)))))
    table += [(d, "one line said again\n" * n) for d, n in ((70, 40), (71, 9), (3, 25), (72, 40), (72, 12))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = phrase_dedup.remove_repeated_phrases(docs, window=12, phrase=5, heavy=heavy, shard_rows=50).collect()
    assert sorted(map(tuple, got)) == plain_phrases([(d, t.encode().split()) for d, t in table], 12)


def test_anchor_depends_on_the_window_alone():
    grams = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    at = phrase_dedup.anchor_positions(grams, 7)
    assert at.tolist() == [i + int(np.argmin(grams[i : i + 7])) for i in range(194)]


def plain_components(table, percent):
    sets = {}
    for d, text in table:
        w = (text or "").encode().translate(common.LOWER).split()
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(grams)
    flat = [(d, g) for d, gs in sets.items() for g in gs]
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    posts = defaultdict(list)
    for k, (_, g) in enumerate(flat):
        for x in g:
            posts[x].append(k)
    for k, (d, g) in enumerate(flat):
        for other, shared in Counter(j for x in g for j in posts[x] if j < k).items():
            e, h = flat[other]
            if 100 * shared >= percent * (len(g) + len(h) - shared):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return sorted((d, len(g), root(d), root(d) == d) for d, g in flat)


@pytest.mark.parametrize("tile", [400_000, 200])
def test_near_duplicates(spark, tile):
    got = near_dup.near_duplicates(frame(spark), 85, tile=tile).collect()
    named = sorted(set(tuple(r) for r in got if r[0] is not None))
    table = sorted({(r[0], r[1]) for r in rows() if r[0] is not None}, key=str)
    want = plain_components(table, 85)
    assert named == sorted(set(want))
    assert len(got) == len(rows()) and [r[2:] for r in got if r[0] is None] == [(None, True)] * 2


def test_tiles_find_every_link():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04 * (k % 4)], rng.integers(0, 1 << 63, k % 9).astype(np.uint64)])) for k in range(40)]

    def groups(links):
        forest = near_dup._Forest(len(sets))
        for a, b in links:
            forest.up[forest.root(a)] = forest.root(b)
        roots = [forest.root(i) for i in range(len(sets))]
        return sorted(sorted(i for i, r in enumerate(roots) if r == x) for x in set(roots))

    def close(a, b):
        n = len(np.intersect1d(a, b))
        return 100 * n >= 85 * (len(a) + len(b) - n)

    want = groups([(i, j) for i in range(40) for j in range(i) if close(sets[i], sets[j])])
    assert groups(near_dup.linked_pairs(sets, None, 64, 85)) == want
    part = np.arange(40) % 2
    inner = [[i for i in range(40) if part[i] == p] for p in (0, 1)]
    links = near_dup.linked_pairs(sets, part, 64, 85)
    for own in inner:
        links += [(own[a], own[b]) for a, b in near_dup.linked_pairs([sets[i] for i in own], None, 64, 85)]
    assert groups(links) == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 120)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(edges, "test").collect()}
    assert got == {**dict.fromkeys(range(121), 0), 500: 500, 501: 500}


def plain_lines(table, m, words=50):
    docs = sorted({(LAST if d is None else d, t) for d, t in table if t is not None})
    blank = " \t\r\x0b\x0c"
    own = [[x for x in t.split("\n") if x.strip(blank)] for _, t in docs]
    first, wholes, out = {}, {}, {}
    for k, lines in enumerate(own):
        wholes.setdefault(tuple(lines), k)
        for n in range(1, m + 1):
            for i in range(len(lines) - n + 1):
                first.setdefault(tuple(lines[i : i + n]), (k, i))
    for k, (d, t) in enumerate(docs):
        idx = [p for p, x in enumerate(t.split("\n")) if x.strip(blank)]
        gone = set()
        for n in range(1, m + 1):
            for i in range(len(idx) - n + 1):
                run = tuple(own[k][i : i + n])
                long = n == m or sum(len(x.split()) for x in run) >= words
                if (long and first[run] != (k, i)) or (n == len(idx) and wholes[run] != k):
                    gone |= set(idx[i : i + n])
        out[(d, t)] = ("\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), len(idx), len(gone))
    return out


@pytest.mark.parametrize("least", [1, 3, 4])
def test_line_runs(spark, least):
    long = prose(400, 40).replace("\n", " ")
    half = [prose(30, 41 + k).replace("\n", " ") for k in range(3)]
    more = [
        (200, f"x\n{long}\ny"), (201, f"z\n{long}\n\n{long}"), (202, long), (203, f"{half[0]}\n{half[1]}\nend"), (204, f"so\n{half[0]}\n\n{half[1]}"),
        (205, f"{half[0]}\n{half[2]}"), (206, "tiny whole\ntext"), (207, "tiny whole\n \ntext"), (208, "so\ntiny whole"), (209, "tiny whole\ntext\nand more"), (210, "text"), (211, "text"),
    ]
    every = rows() + [(d, t, *rows()[0][2:]) for d, t in more]
    table = [(r[0], r[1]) for r in every]
    # Documents of one id with different texts have no order of their own; leave one of each.
    table = [x for k, x in enumerate(table) if not any(x[0] == y[0] and x[1] != y[1] for y in table[:k])]
    some = [r for r in every if (r[0], r[1]) in table]
    want = plain_lines(table, least)
    out = line_runs.remove_repeated_lines(frame(spark, some), least)
    assert out.columns == [c for c in frame(spark).columns if c != "_n_lines"] + ["_n_lines", "_n_removed"]
    got = out.select("doc_id", "text", "_n_lines", "_n_removed").collect()
    expected = [(d, *(want[(LAST if d is None else d, t)] if t is not None else (None, 0, 0))) for d, t in table]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert want[(201, more[1][1])][2] == 2 and want[(207, more[7][1])][2] == 2


def test_sketches_refuse_low_thresholds(spark):
    with pytest.raises(ValueError, match="60"):
        near_dup.near_duplicates(frame(spark), 40)


def test_empty_tables(spark):
    assert phrase_dedup.remove_repeated_phrases(empty(spark)).count() == 0
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    assert line_runs.remove_repeated_lines(empty(spark)).count() == 0
