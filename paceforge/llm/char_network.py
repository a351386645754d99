"""A small convolutional network over characters: training, calibration and scoring.

The network is numpy. :func:`fit` trains it on rows at hand, :func:`fit_blocks` on a table of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a window: before the value, of the value, behind it.
LEFT, VALUE, RIGHT = 24, 40, 8
SPAN = LEFT + VALUE + RIGHT
#: Printable ASCII, other ASCII, everything else, padding.
_OTHER, _WIDE, PAD, CLASSES = 95, 96, 97, 98
_CODES = np.full(129, _OTHER, np.uint8)
_CODES[0x20:0x7F] = np.arange(95)
_CODES[0], _CODES[128] = PAD, _WIDE


def windows(text: str, start: int, end: int) -> str:
    """Windows that together cover the whole value, ``SPAN`` characters each, NUL where there is none."""
    out = []
    for at in range(start, end, VALUE):
        stop = min(end, at + VALUE)
        out.append(text[max(0, at - LEFT) : at].rjust(LEFT, "\0") + text[at:stop].ljust(VALUE, "\0"))
        out.append((text[stop : stop + RIGHT]).ljust(RIGHT, "\0"))
    return "".join(out)


def encode(joined: str) -> np.ndarray:
    """Class codes of joined windows, one row each; characters of the value have codes of their own."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, SPAN)
    codes = _CODES[np.minimum(points, 128)]
    value = codes[:, LEFT : LEFT + VALUE]
    value[value != PAD] += CLASSES
    return codes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over the window, logistic output.

    ``scale`` and ``shift`` calibrate the logit.
    """

    embed: np.ndarray  # classes x dims
    filters: np.ndarray  # (width * dims) x filters
    bias: np.ndarray
    out: np.ndarray  # 2 * filters
    base: float
    width: int
    scale: float = 1.0
    shift: float = 0.0

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        view = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1)
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(-1, self.filters.shape[0])

    def forward(self, x: np.ndarray):
        patches = self._patches(x)
        act = np.maximum(patches @ self.filters + self.bias, 0).reshape(len(x), -1, len(self.bias))
        pooled = np.concatenate([act.max(axis=1), act.mean(axis=1)], axis=1)
        return pooled @ self.out + self.base, (patches, act, pooled)

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Uncalibrated logits in hundredths, so that a table of them stays small whatever it counts; batches
        have one size, so a row's value doesn't depend on its company."""
        out = np.empty(len(x), np.float64)
        for at in range(0, len(x), batch):
            part = x[at : at + batch]
            full = np.full((batch, x.shape[1]), PAD, np.uint8)
            full[: len(part)] = part
            out[at : at + batch] = self.forward(full)[0][: len(part)]
        return np.round(np.clip(out, -30, 30), 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid(z * self.scale + self.shift), 6)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> list[np.ndarray]:
        z, (patches, act, pooled) = self.forward(x)
        n, steps, f = act.shape
        dz = ((_sigmoid(z) - y) * weight / n).astype(np.float32)
        d_pooled = dz[:, None] * self.out
        d_act = np.repeat(d_pooled[:, None, f:] / steps, steps, axis=1)
        top = act.argmax(axis=1)
        d_act[np.arange(n)[:, None], top, np.arange(f)] += d_pooled[:, :f]
        d_act *= act > 0
        flat = d_act.reshape(-1, f)
        d_patch = (flat @ self.filters.T).reshape(n, steps, self.width, -1)
        d_embed = np.zeros_like(self.embed)
        for k in range(self.width):
            codes = x[:, k : k + steps].ravel()
            part = d_patch[:, :, k].reshape(len(codes), -1)
            for j in range(d_embed.shape[1]):
                d_embed[:, j] += np.bincount(codes, part[:, j], len(d_embed)).astype(np.float32)
        return [d_embed, patches.T @ flat, flat.sum(axis=0), dz @ pooled, dz.sum()]


_NAMES = ["embed", "filters", "bias", "out", "base"]


def _start(rng: np.random.Generator, dims: int = 8, width: int = 5, filters: int = 24) -> Network:
    return Network(
        rng.normal(0, 0.3, (2 * CLASSES, dims)).astype(np.float32),
        rng.normal(0, (2 / (width * dims)) ** 0.5, (width * dims, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.1, 2 * filters).astype(np.float32),
        0.0,
        width,
    )


class _Adam:
    """Logistic loss by Adam. Half of the examples of a batch lose the characters around the value, so
    that the value itself counts as well as its context."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.step = net, rate, 0
        self.first = [np.zeros_like(getattr(net, n), dtype=np.float32) for n in _NAMES]
        self.second = [np.zeros_like(m) for m in self.first]

    def epoch(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 128) -> None:
        net, first, second = self.net, self.first, self.second
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            part = x[rows].copy()
            bare = rng.random(len(rows)) < 0.5
            part[np.ix_(bare, [*range(LEFT), *range(LEFT + VALUE, SPAN)])] = PAD
            self.step += 1
            for i, (name, g) in enumerate(zip(_NAMES, net.gradients(part, y[rows], weight[rows]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                move = self.rate * (first[i] / (1 - 0.9**self.step)) / (np.sqrt(second[i] / (1 - 0.99**self.step)) + 1e-6)
                setattr(net, name, (getattr(net, name) - move).astype(np.float32) if name != "base" else float(net.base - move))

    def state(self) -> np.ndarray:
        """Weights and moments as integers, whose sums don't depend on their order."""
        parts = [*(getattr(self.net, n) for n in _NAMES), *self.first, *self.second]
        flat = np.concatenate([np.ravel(p).astype(np.float64) for p in parts])
        return np.round(flat * _UNIT).astype(np.int64)

    def load(self, state: np.ndarray, step: int) -> None:
        at, values = 0, []
        for like in [*(getattr(self.net, n) for n in _NAMES), *self.first, *self.second]:
            size, shape = np.size(like), np.shape(like)
            values.append((state[at : at + size] / _UNIT).reshape(shape).astype(np.float32))
            at += size
        k = len(_NAMES)
        for name, value in zip(_NAMES, values):
            setattr(self.net, name, float(value) if name == "base" else value)
        self.first, self.second, self.step = values[k : 2 * k], values[2 * k :], step


_UNIT = float(2**40)


def fit(
    x: np.ndarray, y: np.ndarray, seed: int = 7, dims: int = 8, width: int = 5, filters: int = 24, epochs: int = 8, batch: int = 128, rate: float = 0.01
) -> Network:
    """A network trained on rows at hand."""
    rng = np.random.default_rng(seed)
    trainer = _Adam(_start(rng, dims, width, filters), rate)
    for _ in range(epochs):
        trainer.epoch(x, y, np.ones(len(x), np.float32), rng, batch)
    return trainer.net


#: Rows of a block, and rounds of training.
BLOCK, ROUNDS = 16_384, 8


def passes(rows: int) -> int:
    """How often every row is used: eight times in a small table, at least once in any."""
    return max(1, min(ROUNDS, 2 ** int(np.log2(max(1, 2 * ROUNDS * BLOCK // max(1, rows))))))


def rounds_of(examples: DataFrame, rows: int) -> list[DataFrame]:
    """The rows of each round with their block, by hash of the window; the rounds use every row :func:`passes` times."""
    apart = ROUNDS // passes(rows)
    blocks = max(1, -(-rows // (apart * BLOCK)))
    place = F.xxhash64("window", F.lit(1))
    placed = examples.withColumn("block", F.pmod(F.shiftright(place, 8), F.lit(blocks)))
    return [placed.filter(F.pmod(place, F.lit(apart)) == k % apart) for k in range(ROUNDS)]


def fit_blocks(examples: DataFrame, rows: int, positives: int, seed: int = 7) -> Network:
    """A network trained on all ``rows`` of a table (window, y), of which ``positives`` have y = 1.

    A round trains one network per block of rows from the same start, and the next one starts from their
    mean. A row's block and rounds follow the hash of its window, so the result doesn't depend on the
    partitioning, and a task holds a block however large the table is. Both classes weigh the same.
    """
    balance = np.array([rows / (2 * max(1, rows - positives)), rows / (2 * max(1, positives))], np.float32)
    trainer = _Adam(_start(np.random.default_rng(seed)))
    size = len(trainer.state())
    for k, used in enumerate(rounds_of(examples, rows)):
        start, step = trainer.state(), trainer.step

        def train(key: tuple, table: pa.Table) -> pa.Table:
            pairs = sorted(zip(table.column("window").to_pylist(), table.column("y").to_pylist()))
            x = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, SPAN)
            y = np.array([c for _, c in pairs], np.int64)
            mine = _Adam(_start(np.random.default_rng(seed)))
            mine.load(start, step)
            mine.epoch(x, y.astype(np.float32), balance[y], np.random.default_rng([seed, k, key[0].as_py()]))
            return pa.table({"state": [mine.state()], "steps": [mine.step]}, pa.schema([("state", pa.list_(pa.int64())), ("steps", pa.int64())]))

        states = used.select("block", "window", "y").groupBy("block").applyInArrow(train, "state array<long>, steps long")
        each = states.select(F.posexplode("state").alias("at", "v"), "steps").groupBy("at")
        mean = each.agg((F.sum(F.col("v").cast("decimal(38,0)")) / F.count("v")).cast("double").alias("v"), F.max("steps").alias("steps"))
        found = mean.orderBy("at").collect()  # as many rows as the network has numbers
        if len(found) == size:
            trainer.load(np.array([r["v"] for r in found]), found[0]["steps"])
    return trainer.net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> Network:
    """Platt scaling on held-out rows with their corpus weights."""
    return calibrate_logits(net, net.logits(x), y, weight / weight.sum() * len(weight), rounds)


def calibrate_logits(net: Network, z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> Network:
    """Platt scaling of weighted logits by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * z + b)
        g = np.array([(w * (p - y) * z).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        h = w * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    return net


def recall_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, recall: float, count: np.ndarray | None = None) -> float:
    """The threshold of the best weighted precision among those that keep ``recall`` of the positives.

    Of equally precise ones the lowest counts, moved half-way (in logits) to the negative below it. A row
    stands for ``count`` positives.
    """
    count = np.ones(len(p), np.int64) if count is None else count
    down = np.argsort(-p[y > 0], kind="stable")
    ranked, so_far = p[y > 0][down], np.cumsum(count[y > 0][down])
    allowed = np.unique(ranked[np.searchsorted(so_far, max(1, int(np.ceil(recall * so_far[-1])))) :])
    true, false = ([weight[(y > 0) == side][p[(y > 0) == side] >= t].sum() for t in allowed] for side in (True, False))
    precision = np.array(true) / np.maximum(np.array(true) + np.array(false), 1e-12)
    chosen = float(allowed[int(np.argmax(precision))])
    below = p[(y == 0) & (p < chosen)]
    if not len(below):
        return chosen / 2
    logits = [float(np.log(v / (1 - v))) for v in np.clip([below.max(), chosen], 1e-6, 1 - 1e-6)]
    return float(_sigmoid(np.array(sum(logits) / 2)))
