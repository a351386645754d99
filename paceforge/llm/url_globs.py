"""URL filter: a bit-parallel automaton that runs all wildcard rules at once.

Every rule is a glob over the canonical URL, ``.host/path`` with the host in ASCII lower case and query
and fragment cut off. All rules together are one multiword Shift-And automaton: each rule owns a run of
bits, bit j meaning that j of its symbols have been read. Reading symbol c takes the state D to
``((D << 1) & step[c]) | (D & stay[c])``; ``stay`` holds the states in front of a ``*``. The words of
many URLs are advanced together, one position at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, by_batch, utf8

_END, _PAD = 256, 257
#: Host rules (verdict, host, path prefix); a rule fits its host and all subdomains.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Globs that block a URL which no host rule fits: host part before the first slash, * for any run.
BLOCK_GLOBS = (
    "adult-*/*",
    "*.ads.*/*",
    "*tracker*/*",
    "*/*/login*",
    "*/cgi-bin/*",
    "*.example.org/*/*00",
    "*/*.zip",
)


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  # (258, words) states that may be entered by a symbol
    stay: np.ndarray  # (258, words) states that a symbol leaves as they are
    start: np.ndarray  # (words,)
    accept: list[tuple[int, int]]  # word and bit of each rule's last state

    def matches(self, urls: Sequence[bytes], cells: int = 2_000_000) -> np.ndarray:
        """(urls, rules) truth table. URLs of like length run together, ``cells`` symbols at a time."""
        out = np.zeros((len(urls), len(self.accept)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        at = 0
        while at < len(order):
            take = 1
            while at + take < len(order) and (take + 1) * (len(urls[order[at + take]]) + 1) <= cells:
                take += 1
            rows = order[at : at + take]
            out[rows] = self._run([urls[i] for i in rows])
            at += take
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        longest = max(map(len, urls)) + 1
        symbols = np.full((longest, len(urls)), _PAD, np.uint16)
        for i, url in enumerate(urls):
            symbols[: len(url), i] = np.frombuffer(url, np.uint8)
            symbols[len(url), i] = _END
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for c in symbols:
            shifted = state << one
            shifted[:, 1:] |= state[:, :-1] >> top
            state = (shifted & self.step[c]) | (state & self.stay[c])
        return np.stack([(state[:, w] >> np.uint64(b)) & one for w, b in self.accept], axis=1).astype(bool)


def compile_globs(globs: Sequence[str]) -> Automaton:
    """A glob is anchored at both ends. ``*`` matches any run; in the host part it stops at the slash."""
    words = max(1, -(-sum(len(g.encode()) + 2 for g in globs) // 64))
    step, stay = np.zeros((258, words), np.uint64), np.zeros((258, words), np.uint64)
    start = np.zeros(words, np.uint64)
    stay[_PAD] = ~np.uint64(0)
    accept, bit = [], 0

    def mark(table: np.ndarray, symbols, at: int) -> None:
        table[symbols, at // 64] |= np.uint64(1 << at % 64)

    for glob in globs:
        start[bit // 64] |= np.uint64(1 << bit % 64)
        in_host = True
        for c in glob.encode():
            if c == ord("*"):
                mark(stay, [x for x in range(256) if not in_host or x != ord("/")], bit)
            else:
                in_host = in_host and c != ord("/")
                bit += 1
                mark(step, [c], bit)
        bit += 1
        mark(step, [_END], bit)
        accept.append((bit // 64, bit % 64))
        bit += 1
    return Automaton(step, stay, start, accept)


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    cut = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition(b"/")
    return host.translate(LOWER), slash + path


def filter_urls(
    pages: DataFrame,
    host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, n_globs.

    A host rule fits its host and every subdomain where the path starts with the rule's; of several the
    longest decides. Without one a URL is blocked if a glob matches it, else allowed. All are judged by
    one automaton. n_globs counts the matching globs.

    Null url or one without '://': host and path empty, allowed. Repeated rows and null page_ids are
    judged like others; other columns are ignored; an empty table gives no rows. Rules of equal length
    are taken in their given order. The rules are parameters and travel with the task.
    """
    rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    # '.host' ends with '.rule' for the host itself and for its subdomains.
    machine = compile_globs([f"*.{host}{path}*" for _, host, path in rules] + [f".{g}" if g[0] != "*" else g for g in block_globs])

    def rows(batch: pa.RecordBatch) -> dict:
        parts = [split_url(u) for u in batch.column("u").to_pylist()]
        hit = machine.matches([b"." + h + p for h, p in parts])
        own, globs = hit[:, : len(rules)], hit[:, len(rules) :].sum(axis=1)
        best = [int(np.argmax(x)) if x.any() else -1 for x in own]
        return {
            "page_id": batch.column("page_id"),
            "host": pa.array([h.decode("utf-8", "replace") for h, _ in parts], pa.string()),
            "path": pa.array([p.decode("utf-8", "replace") for _, p in parts], pa.string()),
            "rule": pa.array([rules[b][1] + rules[b][2] if b >= 0 else None for b in best], pa.string()),
            "verdict": [rules[b][0] if b >= 0 else ("block" if g else "allow") for b, g in zip(best, globs, strict=True)],
            "n_globs": pa.array(globs, pa.int64()),
        }

    own = pages.select("page_id", utf8("url").alias("u"))
    kind = dict(own.dtypes)["page_id"]
    return by_batch(own, rows, f"page_id {kind}, host string, path string, rule string, verdict string, n_globs long")
