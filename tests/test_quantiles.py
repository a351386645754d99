import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.operators import numbering, quantiles
from paceforge.session import stage


@pytest.mark.parametrize("n", [1, 2, 3, 500, 501])
def test_median_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    normal = rng.normal(0, 1e3, n)
    skewed = np.exp(rng.normal(0, 8, n))
    repeated = rng.integers(0, 4, n).astype(float)
    third = np.where(rng.random(n) < 0.34, 7.0, rng.random(n) * 1e-6)
    rows = [tuple(map(float, r)) for r in zip(normal, skewed, repeated, third)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    for kw in ({}, {"gather_limit": 3, "accuracy": 40}, {"gather_limit": 1, "accuracy": 4}):
        got = quantiles.exact_medians(df, ["a", "b", "c", "d"], **kw)
        want = [np.median(v) for v in (normal, skewed, repeated, third)]
        assert list(got.values()) == pytest.approx(want, rel=1e-12, abs=0)


def test_median_skips_missing(spark):
    rows = [(1.0, None), (float("nan"), None), (None, None), (4.0, None), (float("inf"), None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert quantiles.exact_medians(df, ["a", "b"]) == {"a": 2.5, "b": None}


def test_extreme_range(spark):
    df = spark.createDataFrame([(v,) for v in (-1.7e308, -1.0, 2.0, 3.0, 1.7e308)], "a double")
    assert quantiles.exact_medians(df, ["a"], gather_limit=1, accuracy=4) == {"a": 2.0}


@pytest.mark.parametrize("kind", ["decades", "two values", "one value hot", "ordered"])
def test_three_reads_suffice(spark, kind):
    """Values over 600 decades take no more reads than others, and the gathered part stays small."""
    n = 30_000
    rng = np.random.default_rng(4)
    values = {
        "decades": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n),
        "two values": rng.choice([1e-300, 1e300], n),
        "one value hot": np.where(rng.random(n) < 0.34, 5.0, rng.random(n) * 10),
        "ordered": np.arange(n) * 1e290,
    }[kind]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([(float(v),) for v in values], "a double").repartition(6)
    read = stage(table, "values").mapInArrow(count, "a double")
    got = quantiles.exact_medians(read, ["a"], gather_limit=50, accuracy=200)["a"]
    middle = np.sort(values)[[(n - 1) // 2, n // 2]]
    assert got == middle[0] if middle[0] == middle[1] else got == pytest.approx(middle.mean(), rel=1e-12)
    assert seen.value <= 3 * n


def test_numbering(spark):
    rows = [(int(v), f"t{i:03d}") for i, v in enumerate(np.random.default_rng(1).integers(0, 60, 300))]
    df = spark.createDataFrame(rows, "v long, t string").repartition(5)
    out = numbering.number_rows(df, "v", "t", "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, 301))
    assert [(r["v"], r["t"]) for r in out] == sorted(rows)


def test_numbering_spreads_crowded_keys(spark, monkeypatch):
    """99 in 100 keys in the first thousandth of the range: partitions stay within a few times the mean."""
    pinned = []
    monkeypatch.setattr(numbering, "stage", lambda df, label: pinned.append(stage(df, label)) or pinned[-1])
    df = spark.range(20_000).selectExpr("if(id % 100 = 0, id * 1000000, id) AS v", "cast(id AS string) AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.number_rows(df, "v", "t", "n")
        parts = [r["count"] for r in pinned[0].groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) >= 6 and max(parts) < 3 * 20_000 / len(parts)
    assert out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 20_000, 20_000)


def test_numbering_takes_text_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    got = {r["k"]: r["n"] for r in numbering.number_sorted(df, ["k"], "n").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, None: 4}
