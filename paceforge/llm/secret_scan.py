"""Secret scan: fixed patterns, and a character network over every other candidate.

One pass over the texts finds the pattern spans and all candidates, runs of at least twelve characters that
secrets are made of, each with windows of its characters and surroundings that cover the whole run. A
candidate that overlaps a pattern span is a labelled finding of that kind, the others are negatives. Two
thirds of all distinct labelled windows train the network, block by block; the others, all of them, calibrate
it by corpus weights and set the thresholds, the most precise ones that keep the wanted recall. Then all
candidates are scored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm import char_network
from paceforge.llm.common import Tables
from paceforge.session import stage

#: Fixed patterns; group 2 of assign is the value.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Kinds in the order of equal starts.
KINDS = ["assign", "access", "hex", "model"]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api")

SPANS = "array<struct<kind: string, start: long, end: long>>"
CANDIDATES = "array<struct<start: long, end: long, label: string, shape: string, windows: binary>>"


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns by start, then kind; leftmost non-overlapping per kind."""
    out = []
    folded = text.lower()
    if any(k in folded for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape_of(value: str) -> str:
    """letters, digits or mixed; signs don't count."""
    digits, letters = bool(re.search(r"[0-9]", value)), bool(re.search(r"[A-Za-z]", value))
    return "mixed" if digits and letters else "digits" if digits else "letters"


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, label, shape); the label is the kind of the first pattern span it overlaps, or none."""
    out, first = [], 0
    for m in CANDIDATE.finditer(text):
        while first < len(spans) and spans[first][1] <= m.start():
            first += 1
        label = "none"
        for reach in range(first, len(spans)):
            start, end, kind = spans[reach]
            if start >= m.end():
                break
            if end > m.start():
                label = kind
                break
        out.append((m.start(), m.end(), label, shape_of(m.group())))
    return out


def _found(batches: Tables) -> Tables:
    for batch in batches:
        spans, runs = [], []
        for text in batch.column("_text").to_pylist():
            text = text or ""
            mine = pattern_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for s, e, k in mine])
            found = candidates(text, mine)
            codes = char_network.encode("".join(char_network.windows(text, s, e) for s, e, _, _ in found))
            at, row = 0, []
            for s, e, label, shape in found:
                n = -(-(e - s) // char_network.VALUE)
                row.append({"start": s, "end": e, "label": label, "shape": shape, "windows": codes[at : at + n].tobytes()})
                at += n
            runs.append(row)
        columns = {name: batch.column(name) for name in batch.schema.names if name != "_text"}
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        cands = pa.list_(
            pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("shape", pa.string()), ("windows", pa.binary())])
        )
        yield pa.RecordBatch.from_pydict(columns | {"spans": pa.array(spans, kinds), "candidates": pa.array(runs, cands)})


def labelled_windows(found: DataFrame) -> DataFrame:
    """All distinct labelled windows: window, y (1 for a finding of any kind), shape, n (how many windows of
    the corpus each one stands for), held (a third, by hash of the window)."""
    span = char_network.SPAN
    each = found.select(F.explode("candidates").alias("c")).select("c.label", "c.shape", "c.windows")
    cut = F.transform(F.sequence(F.lit(0), (F.length("windows") / span).cast("int") - 1), lambda i: F.substring("windows", i * span + 1, F.lit(span)))
    rows = each.select("label", "shape", F.explode(cut).alias("window")).groupBy("label", "window").agg(F.count("*").alias("n"), F.max("shape").alias("shape"))
    held = F.pmod(F.xxhash64("window"), F.lit(3)) == 2
    return stage(rows.select("window", (F.col("label") != "none").cast("int").alias("y"), "shape", "n", held.alias("held")), "secret-windows")


def _logits(net: char_network.Network):
    def run(batches: Tables) -> Tables:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(-1, char_network.SPAN)
            columns = {name: batch.column(name) for name in ("y", "shape", "n")}
            yield pa.RecordBatch.from_pydict(columns | {"z": pa.array(net.logits(codes), pa.float64())})

    return run


def train(windows: DataFrame, recall: float, least: int) -> tuple[char_network.Network, dict[str, float]] | None:
    """Network and threshold per shape; None where there are fewer than ``least`` findings or negatives.

    ``windows`` are those of :func:`labelled_windows`. Those held out are counted by their logit, in
    hundredths, so that the counts of any table fit the driver; calibration and thresholds follow from all of
    them. A shape with at least ``least`` held-out findings has its own threshold, others the common one.
    """
    counted = windows.groupBy("held", "y").count().collect()  # at most four rows
    sizes = {(r["held"], r["y"]): r["count"] for r in counted}
    if len(sizes) < 4 or min(sizes[False, y] + sizes[True, y] for y in (0, 1)) < least:
        return None
    fitted = windows.filter("NOT held").select("window", "y")
    net = char_network.fit_blocks(fitted, sizes[False, 0] + sizes[False, 1], sizes[False, 1])
    scored = windows.filter("held").select("window", "y", "shape", "n").mapInArrow(_logits(net), "y int, shape string, n long, z double")
    # at most 6,001 logits of two classes and three shapes
    cells = scored.groupBy("shape", "y", "z").agg(F.count("*").alias("windows"), F.sum("n").alias("n")).orderBy("shape", "y", "z").collect()
    shapes = np.array([r["shape"] for r in cells])
    y, z, count, weight = (np.array([r[c] for r in cells], np.float64) for c in ("y", "z", "windows", "n"))
    char_network.calibrate_logits(net, z, y, weight / weight.sum() * count.sum())
    p = net.calibrated(z)

    def limit(rows: np.ndarray) -> float:
        return char_network.recall_threshold(p[rows], y[rows], weight[rows], recall, count[rows])

    limits = {"": limit(np.ones(len(cells), bool))}
    for shape in sorted(set(shapes.tolist())):
        rows = shapes == shape
        if count[rows & (y > 0)].sum() >= least:
            limits[shape] = limit(rows)
    return net, limits


def _scored(model):
    def run(batches: Tables) -> Tables:
        for batch in batches:
            rows = batch.column("candidates").to_pylist()
            open_runs = [[c for c in row if c["label"] == "none"] for row in rows]
            codes = np.frombuffer(b"".join(c["windows"] for row in open_runs for c in row), np.uint8).reshape(-1, char_network.SPAN)
            added = [[] for _ in rows]
            if model is not None and len(codes):
                net, limits = model
                p, at = net.probabilities(codes), 0
                for row, out in zip(open_runs, added):
                    for c in row:
                        n = len(c["windows"]) // char_network.SPAN
                        score, at = float(p[at : at + n].max()), at + n
                        if score >= limits.get(c["shape"], limits[""]):
                            out.append({"start": c["start"], "end": c["end"], "probability": score})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            columns = {name: batch.column(name) for name in batch.schema.names if name != "candidates"}
            yield pa.RecordBatch.from_pydict(columns | {"added": pa.array(added, kind)})

    return run


def _findings(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, str]:
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {own.schema['_id'].dataType.simpleString()}, spans {SPANS}"
    return stage(own.mapInArrow(_found, f"{schema}, candidates {CANDIDATES}"), "secrets"), schema


def scan(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    recall: float = 0.95,
    least: int = 20,
    trained_on: DataFrame | None = None,
) -> DataFrame:
    """Secrets of every whole text: key, spans (pattern hits), added (the network's), in code points.

    The labelled findings are those of ``trained_on``, a table with the same two columns, or of ``docs``.
    All of them take part, two thirds in training and one in calibration. The thresholds keep ``recall`` of
    the held-out findings. A candidate that overlaps a pattern span is not added again. With fewer than ``least``
    distinct findings or negatives there is nothing to learn from and nothing is added.

    A null text is empty. Repeated rows and keys stay separate rows, a null key stays null, an empty table
    gives no rows. Candidates of any length are covered by windows. Other columns are ignored.
    """
    found, schema = _findings(docs, text, key)
    source = found if trained_on is None else _findings(trained_on, text, key)[0]
    model = train(labelled_windows(source), recall, least)
    out = f"{schema}, added array<struct<start: long, end: long, probability: double>>"
    return found.mapInArrow(_scored(model), out).withColumnRenamed("_id", key)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the pattern spans and all spans as text, ``kind:start:end`` by start."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def show(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    # structs sort by start, then the kind's place, then end
    places = F.transform("spans", lambda s: F.struct(s["start"], F.array_position(F.lit(KINDS), s["kind"]).alias("k"), s["end"], s["kind"]))
    more = F.transform("added", lambda s: F.struct(s["start"], F.lit(len(KINDS)).cast("bigint").alias("k"), s["end"], F.lit("model").alias("kind")))
    base = F.array_join(F.transform("spans", show), ",")
    every = F.array_join(F.transform(F.array_sort(F.concat(places, more)), show), ",")
    rest = [c for c in found.columns if c not in ("spans", "added")]
    return found.select(
        *rest, count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("added").cast("bigint").alias("n_model")
    )
