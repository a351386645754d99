"""Histories that grow by batches, against the flow over all rows at once."""

import random
from datetime import datetime, timedelta

import pytest

from helpers import count_nodes, same
from paceforge.plans import flow
from paceforge.streaming import history, ingest

START = datetime(2024, 1, 1)
SCHEMA = "activity_id string, runner_id string, date timestamp_ntz, distance double, moving_time double, average_heart_rate double, average_cadence double"


def rows(n=160, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        date = START + timedelta(hours=12 * rnd.randint(0, 200)) if rnd.random() > 0.05 else None
        runner = rnd.choice("aaabcd") if rnd.random() > 0.05 else None
        out.append((str(i), runner, date, float(rnd.randint(1, 80)) / 4, 600.0 + i, float(rnd.randint(90, 180)), 80.0 + i % 9))
    return out


def whole(spark, table):
    return flow.features(history.canonical(spark.createDataFrame(table, SCHEMA)), 4)


def check(spark, store, table):
    got = store.read()
    want = whole(spark, table)
    same(got.select(*[f"`{c}`" for c in want.columns]), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_files_in_any_order(spark, tmp_path, seed):
    table = rows(seed=seed)
    rnd = random.Random(seed)
    parts = [[], [], [], []]
    for r in table:
        rnd.choice(parts).append(r)
    store = history.History(spark, str(tmp_path / "h"), buckets=5)
    for k, part in enumerate(parts):
        assert store.update(spark.createDataFrame(part, SCHEMA), k)
    check(spark, store, table)
    assert not store.update(spark.createDataFrame(parts[2], SCHEMA), 2)


def test_corrections_replace_and_move_activities(spark, tmp_path):
    table = rows(80, 3)
    store = history.History(spark, str(tmp_path / "h"), buckets=3)
    old = [(a, r, None if d is None else d + timedelta(days=9 * (int(a) % 2)), x * 2, *rest) for a, r, d, x, *rest in table]
    store.update(spark.createDataFrame(old, SCHEMA), 0)
    # the later date of two rows of a batch wins, so the earlier one leaves no trace
    again = table + [(a, r, None if d is None else d - timedelta(days=3), 90.0, *rest) for a, r, d, x, *rest in table if d is not None]
    store.update(spark.createDataFrame(again, SCHEMA), 1)
    check(spark, store, table)


def test_stored_rows_are_joined_once_for_what_is_computed_again(spark, tmp_path, monkeypatch):
    """Ids of the batch meet the keys of stored rows; near and far rows then join the earliest changes only."""
    table = rows(90, 7)
    store = history.History(spark, str(tmp_path / "h"), buckets=3)
    store.update(spark.createDataFrame(table[:60], SCHEMA), 0)
    staged, write = {}, history.stage
    monkeypatch.setattr(history, "stage", lambda df, label: write(staged.setdefault(label, df), label))
    monkeypatch.setattr(history.History, "_state", lambda self, f=history.History._state, **how: staged.setdefault("reads", []).append(1) or f(self, **how))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.update(spark.createDataFrame(table[40:], SCHEMA), 1)
        joins = count_nodes(staged["history-rows"], "SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert joins == 3 and len(staged["reads"]) == 1
    monkeypatch.undo()
    check(spark, store, table)


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = [r for r in rows(120, 4) if r[1] in ("a", "b", "c", "d")]
    store = history.History(spark, str(tmp_path / "h"), buckets=40)
    store.update(spark.createDataFrame([r for r in table if r[1] != "b"], SCHEMA), 0)
    store.update(spark.createDataFrame([r for r in table if r[1] == "b"], SCHEMA), 1)
    folders = store._state()[1]
    assert len(set(folders.values())) == 2 and sum(f.endswith("batch=1") for f in folders.values()) == 1
    check(spark, store, table)


def test_a_batch_that_died_shows_nothing_and_is_run_again(spark, tmp_path):
    table = rows(90, 5)
    store = history.History(spark, str(tmp_path / "h"), buckets=4)
    store.update(spark.createDataFrame(table[:50], SCHEMA), 0)
    # the second batch wrote part of its folder and died before its record
    spark.createDataFrame([("junk",)], "activity_id string").write.parquet(str(tmp_path / "h" / "data" / "batch=1" / "bucket=0"))
    check(spark, store, table[:50])
    store.update(spark.createDataFrame(table[50:], SCHEMA), 1)
    check(spark, store, table)
    store.update(spark.createDataFrame([], SCHEMA), 2)
    check(spark, store, table)
    with pytest.raises(FileNotFoundError):
        history.History(spark, str(tmp_path / "none")).read()


def test_runner_numbers_stay(spark, tmp_path):
    store = history.History(spark, str(tmp_path / "h"), buckets=4)
    table = rows(60, 6)
    store.update(spark.createDataFrame([r for r in table if r[1] in ("c", "d")], SCHEMA), 0)
    first = {r["runner_id"]: r["number"] for r in store.number_runners(0).collect()}
    store.update(spark.createDataFrame(table, SCHEMA), 1)
    store.number_runners(1)
    second = {r["runner_id"]: r["number"] for r in store.number_runners(1).collect()}
    assert first == {"c": 1, "d": 2} and second == {"c": 1, "d": 2, "a": 3, "b": 4}


HEAD = "Activity ID,Activity Date,Activity Type,Distance,Elapsed Time,Athlete ID,Average Heart Rate,Moving Time\n"


def test_uploads_build_the_history(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = [f"{i},2024-01-{1 + i:02d} 08:00:00,Run,{5 + i % 3},1800,77,150,1500\n" for i in range(12)]
    store = history.History(spark, str(tmp_path / "h"), buckets=2)
    for name, part in (("b.csv", lines[6:]), ("a.csv", lines[:6])):
        (inbox / name).write_text(HEAD + "".join(part))
        ingest.ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"), 2, history=store)
    got = {r["activity_id"]: r for r in store.read().collect()}
    assert len(got) == 12 and got["6"]["distance_previous"] == 7.0 and got["11"]["30d_run_count"] == 12
