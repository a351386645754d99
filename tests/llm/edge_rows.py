"""Rows that every text operator must take, and plain versions to hold results against."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, t string, ord int, h int, tie int, "
    "`group` int, bin string, words int, key int, host string, lines int, node int, rep int, e int, o int, i int, "
    "p int, r int, first int, body string, cluster string, _n_lines int"
)
CLASH = (1, "x", 2, 3, 4, 5, "b", 6, 7, "h", 8, 9, 10, 11, 12, 13, 14, 15, 16, "q", "c", 17)

_rnd = random.Random(11)
WORDS = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(20)]


def prose(n: int, seed: int, per_line: int = 14) -> str:
    rnd = random.Random(seed)
    words = [rnd.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


def edited(text: str, every: int, seed: int) -> str:
    rnd = random.Random(seed)
    words = text.split(" ")
    for i in range(0, len(words), every):
        words[i] = f"x{rnd.randint(0, 9)}"
    return " ".join(words)


def rows() -> list[tuple]:
    base, shared = prose(300, 1), prose(80, 2)
    texts = [
        (1, base), (2, base), (3, edited(base, 40, 3)), (4, edited(base, 15, 4)), (5, None), (6, ""), (7, " \n\t "),
        (8, "one two three"), (9, "one two three"), (10, prose(120, 5) + "\n" + shared), (11, shared + "\n" + prose(90, 6)),
        (12, prose(60, 7)), (12, prose(60, 7)), (12, prose(70, 8)), (None, base), (None, prose(55, 9)), (13, prose(30_000, 10)),
        (14, "a b c " * 100), (15, "same line\n" * 9), (16, "MIT License and GNU General  Public\nLicense. mit-license"),
        (17, prose(200, 12, per_line=200)), (18, "x" * 50_000), (19, "\n".join([prose(60, 13)] * 2)),
    ]
    out = [(d, t, "en", None if d == 8 else f"s{(d or 0) % 3}", None if t is None else len(t), *CLASH) for d, t in texts]
    for k in range(20, 80):  # a group of copies and a common line
        out.append((k, "a common line of eight words stands here\n" + prose(60 + k, k), "en", "s0", 5, *CLASH))
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
