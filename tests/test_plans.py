"""Physical plans: exchanges, sorts, pruning, no single-task windows on big inputs."""

import re

from pyspark.sql import functions as F

from helpers import plan
from paceforge import testbed
from paceforge.operators import cleaning, scoring, selection, skew, timeline
from paceforge.plans import flow, querybook
from paceforge.session import shuffle_partitions

querybook.load()


def nodes(text, name):
    return len(re.findall(rf"(?<![A-Za-z]){name}(?![A-Za-z])", text))


def test_features_use_one_exchange_and_sort(spark, sf):
    valid = testbed.activities(spark, sf).transform(cleaning.filter_valid_runs)
    text = plan(flow.features(valid, lags=4))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert text.count("Window [") <= 3


def test_filters_and_columns_reach_the_scan(spark, sf):
    lines = testbed.line_runs(spark, sf).filter("distance > 10").select("activity_id", "distance")
    text = plan(lines)
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "l_shipdate" not in text and "l_extendedprice" not in text


def test_latest_run_has_no_join(spark, sf):
    text = plan(selection.latest_run(testbed.order_runs(spark, sf)))
    assert "Join" not in text and "EqualTo(o_orderdate,ScalarSubquery" in text


def test_trailing_months_push_their_date(spark, sf):
    text = plan(selection.trailing_months(testbed.order_runs(spark, sf), 3))
    assert "GreaterThanOrEqual(o_orderdate,ScalarSubquery" in text


def test_recent_runs_limits_before_the_shuffle(spark, sf):
    runs = testbed.order_runs(spark, sf)
    text = plan(scoring.recent_runs(runs, ["distance"]))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_undated_rows_are_spread(spark):
    df = spark.range(5000).select(
        F.col("id").alias("activity_id"), F.lit("a").alias("runner_id"), F.lit(None).cast("timestamp_ntz").alias("date")
    )
    shards = skew.with_shard(df, "runner_id", "date", "activity_id").select("_shard").distinct().count()
    assert shards > 1000


def test_no_cross_joins_and_no_python_rows(spark, sf):
    slow = {"gbt_predictions", "score_runs", "param_search", "cv_search", "gain_importance", "shap_attributions", "shap_additivity", "ingest_status_log", "gbt_rounds", "incremental_history"}
    slow |= {name for name in querybook.QUERIES if name.startswith("stump_")} | {"score_requests"}
    for name, fn in querybook.QUERIES.items():
        if name in slow:
            continue
        text = plan(fn(spark, sf))
        for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert banned not in text, (name, banned)


def test_numbering_windows_are_bounded(spark, sf):
    """The only window without partition keys runs over the bucket counts."""
    text = plan(cleaning.dense_runner_ids(testbed.activities(spark, sf)))
    assert text.count("Exchange SinglePartition") <= 1


def test_trailing_plain_plan(spark, sf):
    df = timeline.add_trailing(testbed.line_runs(spark, sf))
    text = plan(df)
    assert text.count("Exchange hashpartitioning(runner_id") == 1 and "_chunk" not in text


def test_numbered_features_move_rows_once(spark, sf):
    """The ids join by key and the windows share one exchange of the wide rows."""
    valid = testbed.activities(spark, sf).transform(cleaning.filter_valid_runs)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(flow.tabular(valid))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text and "Union" not in text
    # one exchange of the rows and one of the ids; the windows take the partitioning of the join
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len([e for e in exchanges if e.startswith("runner_id")]) == 2
    assert not any("_shard" in e for e in exchanges)


def test_shuffle_partitions_follow_the_input():
    assert shuffle_partitions(10**9) == 200 and shuffle_partitions(100 * 10**12) > 100_000
