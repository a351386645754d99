"""The secret network learns from all labelled windows of a table."""

import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm import char_network, secret_scan


def windows(spark, n):
    """Distinct labelled windows, every tenth one a finding."""
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        finding = i % 10 == 0
        letters = string.ascii_letters + string.digits if finding else string.ascii_lowercase
        value = "".join(rnd.choice(letters) for _ in range(24))
        rows.append((bytes(char_network.encode(char_network.windows(f"see {value} ", 4, 28)).tobytes()), int(finding), "mixed" if finding else "letters", 1, i % 3 == 2))
    return spark.createDataFrame(rows, "window binary, y int, shape string, n long, held boolean")


def test_every_window_is_used(spark, monkeypatch):
    """More distinct negatives than the 6,000 of the former sample."""
    fitted = windows(spark, 12_000).filter("NOT held").select("window", "y")
    for block, times in ((500, 1), (2_000, 4), (20_000, 8)):
        monkeypatch.setattr(char_network, "BLOCK", block)
        assert char_network.passes(8_000) == times
        rounds = char_network.rounds_of(fitted, 8_000)
        used = reduce(DataFrame.unionByName, [r.withColumn("round", F.lit(k)) for k, r in enumerate(rounds)])
        each = used.groupBy("window").agg(F.count("*").alias("n"))
        assert [tuple(r) for r in each.groupBy("n").count().collect()] == [(times, 8_000)]
        assert used.groupBy("round", "block").count().agg(F.max("count")).first()[0] < 1.3 * block


def test_blocks_train_alike_whatever_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(char_network, "BLOCK", 500)
    table = windows(spark, 3000)
    (one, limits), (two, same) = (secret_scan.train(table.repartition(k), 0.95, 20) for k in (2, 7))
    assert limits == same and np.array_equal(one.embed, two.embed) and one.scale == two.scale
    held = table.filter("held").collect()
    codes = np.frombuffer(b"".join(r["window"] for r in held), np.uint8).reshape(-1, char_network.SPAN)
    y = np.array([r["y"] for r in held])
    found = one.probabilities(codes) >= limits[""]
    assert found[y > 0].mean() >= 0.95 and found[y == 0].mean() <= 0.05


def test_counts_stand_for_rows():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    p = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 2)
    cells, place, count = np.unique(np.stack([p, y]), axis=1, return_inverse=True, return_counts=True)
    for recall in (0.1, 0.5, 0.95, 1.0):
        whole = char_network.recall_threshold(p, y, np.ones(400), recall)
        assert char_network.recall_threshold(cells[0], cells[1], count.astype(float), recall, count) == whole


def test_passes():
    assert [char_network.passes(n) for n in (1, 32_768, 32_769, 65_537, 10**7)] == [8, 8, 4, 2, 1]


def test_fewer_findings_than_needed_teach_nothing(spark):
    assert secret_scan.train(windows(spark, 150), 0.95, 20) is None
    assert secret_scan.train(windows(spark, 300).filter("NOT held"), 0.95, 20) is None
