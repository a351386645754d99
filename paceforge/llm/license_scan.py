"""License scan by an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, whatever the line breaks and signs between them, at most a quarter and
one word longer than the template, so words far apart make no match. It matches if it holds at least
``threshold`` of the template's distinct words. Words are ordered by how often the whole corpus uses them,
rarest first. A block that reaches the overlap ``need`` must hold one of the first ``size - need + 1`` words of
the template in this order (prefix filter), must have ``need`` of its words at all (length filter), and the
words left behind the first shared one must suffice (positional filter). Only the surroundings of prefix words
are read further; there all blocks are counted exactly. The filters lose nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import Tables, by_batch, utf8

#: Phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that licenses ask to be kept in a text, whole or in the usual short form.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved"),
)
#: Separators of words, A-Z lower-cased. Bytes from 0x80 on belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def block_words(template: Sequence[bytes]) -> int:
    """How many words a block may have for a template of these words."""
    return len(template) + len(template) // 4 + 1


class TemplateIndex:
    """Templates as word lists in the global order, with their prefixes inverted."""

    def __init__(self, templates: Sequence[tuple[str, str]], used: dict[bytes, int], threshold: float):
        self.labels, self.words, self.need, self.span = [], [], [], []
        self.prefix: dict[bytes, list[int]] = {}
        for i, (label, text) in enumerate(templates):
            every = tokens(text.encode())
            words = sorted(set(every), key=lambda w: (used.get(w, 0), w))
            need = max(1, ceil(threshold * len(words) - 1e-9))
            self.labels.append(label)
            self.words.append({w: at for at, w in enumerate(words)})
            self.need.append(need)
            self.span.append(block_words(every))
            for w in words[: len(words) - need + 1]:
                self.prefix.setdefault(w, []).append(i)
        self.known = frozenset(w for ws in self.words for w in ws)
        self.heads = frozenset(self.prefix)

    def matches(self, text: Sequence[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of the blocks of ``text`` that reach the threshold.

        Of overlapping blocks of a template the fullest is given, the first of several.
        """
        if self.heads.isdisjoint(text):
            return []
        places = [(at, w) for at, w in enumerate(text) if w in self.known]
        near: dict[int, list[int]] = {}
        for at, w in places:
            for i in self.prefix.get(w, ()):
                near.setdefault(i, []).append(at)
        found = []
        for i in sorted(near):
            found += self._blocks(i, near[i], places)
        return found

    def _blocks(self, i: int, heads: list[int], places: list[tuple[int, bytes]]) -> list[tuple[int, int, int, float]]:
        ranks, need, span = self.words[i], self.need[i], self.span[i]
        mine = [(at, ranks[w]) for at, w in places if w in ranks]
        if len({r for _, r in mine}) < need:
            return []
        out: list[tuple[int, int, int, float]] = []
        held: dict[int, int] = {}
        first = h = 0
        for at, rank in mine:
            held[rank] = held.get(rank, 0) + 1
            while mine[first][0] <= at - span:
                old = mine[first][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                first += 1
            while h < len(heads) and heads[h] <= at - span:
                h += 1
            # no prefix word within the block, or too few words behind the rarest one it holds
            if h == len(heads) or heads[h] > at or len(held) < need or len(ranks) - min(held) < need:
                continue
            block = (i, mine[first][0], at + 1, len(held) / len(ranks))
            if out and block[1] < out[-1][2]:
                if block[3] > out[-1][3]:
                    out[-1] = block
            else:
                out.append(block)
        return out


def word_usage(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often all documents use each word of ``vocabulary``; one number per word reaches the driver."""

    def run(batches: Tables) -> Tables:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(filter(vocabulary.__contains__, tokens(text)))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(total), pa.binary()), "n": pa.array(total.values(), pa.int64())})

    counts = docs.select(utf8("text").alias("body")).mapInArrow(run, "w binary, n long")
    return {bytes(w): n for w, n in counts.groupBy("w").agg(F.sum("n")).collect()}


def base_places(words: list[bytes], phrases: dict[bytes, list[tuple[list[bytes], str]]]) -> list[tuple[int, str]]:
    """(start, label) of every phrase; ``phrases`` is keyed by the last word."""
    places = []
    for last, ways in phrases.items():
        at = -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            places += [(at + 1 - len(p), label) for p, label in ways if at + 1 >= len(p) and words[at + 1 - len(p) : at + 1] == p]
    return places


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = 0.9,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Base: places where the words of a phrase stand consecutively. labels adds those of every template that
    a block of the text holds to ``threshold``; blocks lists them as (first word, end, label, containment).
    score is the largest containment, 1 with a base phrase, else 0.

    Null or empty text: no words, no labels, score 0. Repeated rows and null doc_ids are scanned like
    others; other columns are ignored; an empty table gives no rows. Templates and phrases are parameters
    and travel with the task.
    """
    vocabulary = frozenset(w for _, t in templates for w in tokens(t.encode()))
    index = TemplateIndex(templates, word_usage(docs, vocabulary), threshold)
    ways: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases:
        p = tokens(phrase.encode())
        ways.setdefault(p[-1], []).append((p, label))

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")}
        for text in batch.column("body").to_pylist():
            words = tokens(text or b"")
            places = base_places(words, ways)
            blocks = [
                {"first": first, "end": end, "label": index.labels[k], "containment": c}
                for k, first, end, c in index.matches(words)
            ]
            base = {label for _, label in places}
            starts = [s for s, _ in places]
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {b["label"] for b in blocks})))
            out["score"].append(1.0 if places else max((b["containment"] for b in blocks), default=0.0))
            out["blocks"].append(blocks)
        longs = {c: pa.array(out[c], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")}
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        return {"doc_id": batch.column("doc_id")} | out | longs | {"score": pa.array(out["score"], pa.float64()), "blocks": pa.array(out["blocks"], kind)}

    own = docs.select("doc_id", utf8("text").alias("body"))
    kind = dict(own.dtypes)["doc_id"]
    return by_batch(
        own,
        rows,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, blocks array<struct<first: long, end: long, label: string, containment: double>>",
    )
