"""Readers, sinks, reports as text, ingest."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import same
from paceforge import testbed
from paceforge.operators import cleaning, reports, selection, trends
from paceforge.plans import flow
from paceforge.sources import activities, sinks
from paceforge.streaming import ingest

EXPORT = '''Activity ID,Activity Date,Activity Type,Distance,Elapsed Time,Elapsed Time,Athlete ID,Average Heart Rate,Moving Time,"Device, used"
11,2024-01-01 08:00:00,Run,5.0,1800,9,77,150,1500,"watch ""x"""
12,2024-01-03 08:00:00,run,6.0,2000,9,77,140,1800,
13,2024-01-03 09:00:00,Ride,9.0,2000,9,77,140,1800,
14,2024-01-02 08:00:00,RUN,4.0,1000,9,5,145,1200,
'''


@pytest.fixture()
def export(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(EXPORT)
    return str(path)


def test_repeated_headers_keep_the_first(spark, export):
    df = activities.read_activities(spark, export)
    assert df.columns[4:6] == ["Elapsed Time", "Elapsed Time.1"] and df.columns[-1] == "Device, used"
    cleaned = cleaning.clean(df)
    assert {r["elapsed_time"] for r in cleaned.collect()} == {1800.0, 2000.0, 1000.0}
    assert df.first()["Device, used"] == 'watch "x"'


def test_stages(spark, export, tmp_path):
    out = str(tmp_path / "out")
    counts = flow.write_stages(activities.read_activities(spark, export), out)
    assert counts == {"cleaned": 3, "raw": 4, "features": 3, "tabular": 3, "sequences": 0}
    rows = spark.read.parquet(f"{out}/tabular").orderBy("activity_id").collect()
    assert [r["runner_id"] for r in rows] == ["01", "01", "02"]
    assert [r["pace"] for r in rows] == ["5'00\"", "5'00\"", "5'00\""]
    assert [r["pace_previous"] for r in rows] == ["", "5'00\"", ""]
    assert rows[1]["days_since_last_run"] == 2 and rows[1]["pace_t-1"] == "5:00"
    features = spark.read.parquet(f"{out}/features")
    assert features.columns[:4] == ["activity_id", "runner_id", "date", "activity_type"]


def test_stages_work_histories_out_once(spark, export, tmp_path, monkeypatch):
    out, calls, numbered = str(tmp_path / "out"), [], flow._numbered
    monkeypatch.setattr(flow, "_numbered", lambda *a: calls.append(a) or numbered(*a))
    flow.write_stages(activities.read_activities(spark, export), out)
    assert len(calls) == 1
    monkeypatch.undo()
    want = flow.feature_stage(spark.read.parquet(f"{out}/cleaned"), ordinal=flow.SOURCE_ROW).drop(flow.SOURCE_ROW)
    got = spark.read.parquet(f"{out}/features")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    same(got, want)


def test_pace_text_is_parsed_and_gaps_recomputed(spark):
    df = spark.createDataFrame(
        [("7'30\"", 600.0, 2.0), (None, 600.0, 2.0), ("abc", 600.0, 2.0)], "pace string, moving_time double, distance double"
    )
    assert [r["pace_minutes"] for r in flow.with_pace(df).collect()] == [7.5, 5.0, 5.0]
    speed = spark.createDataFrame([(10.0,), (0.0,)], "average_speed double")
    assert [r["pace_minutes"] for r in flow.with_pace(speed).collect()] == [6.0, None]


def test_month_ends_are_clamped(spark):
    dates = [datetime(2025, 5, 31, 13, 17, 35), datetime(2025, 2, 28, 13, 17, 35), datetime(2025, 2, 28, 13, 17, 34)]
    df = spark.createDataFrame([(d,) for d in dates], "date timestamp_ntz")
    assert selection.trailing_months(df, 3).count() == 2


def test_ties_at_the_latest_date(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, day, "x", 1.0, 0.5), (2, day, "x", 3.0, -0.1), (3, datetime(2023, 1, 1), "x", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "activity_id long, date timestamp_ntz, feature string, value double, shap double")
    row = reports.improvement_report(df).first()
    assert row["mean_shap"] == pytest.approx(0.2) and row["importance"] == pytest.approx(0.3)
    assert row["advice"] == "Faster with less of: x"


def test_weeks_run_forward(spark, sf):
    recent = selection.trailing_months(testbed.attributions(spark, sf), 3)
    periods = trends.period_means(trends.with_week(recent))
    bounds = periods.agg(F.min("period"), F.max("period")).first()
    assert bounds[1] == -1 and bounds[0] >= -13


def test_single_period_has_no_trend(spark):
    df = spark.createDataFrame([("2024-01", "x", 1.0, 0.5)], "period string, feature string, avg_value double, avg_shap double")
    assert trends.shap_trend(df).count() == 0 and trends.value_correlation(df).count() == 0
    report = reports.trend_report(df).first()
    assert report["pct_change"] is None and report["trend"] is None


def test_totals_wording(spark):
    def totals(shaps):
        rows = [(i + 1, f"f{i}", s, round(s * 60)) for i, s in enumerate(shaps)]
        df = spark.createDataFrame(rows, "rank int, feature string, mean_shap double, seconds long")
        return tuple(reports.impact_totals(df).first())

    assert totals([1.0, 2.0, 3.0, -1.0]) == (360, 60, "f0, f1 & f2", "f3")
    assert totals([-1.0, -2.0]) == (0, 180, "", "f0 & f1")


def test_report_texts(spark, sf, tmp_path):
    df = testbed.attributions(spark, sf)
    report = reports.improvement_report(df)
    path = str(tmp_path / "report")
    sinks.write_lines(reports.improvement_lines(report), path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == "What moved the pace most" and "What to try" in lines and len(lines) == 6
    assert reports.impact_lines(reports.impact_report(df)).count() == 2
    periods = trends.period_means(trends.with_month(df))
    text = [r["text"] for r in reports.trend_lines(reports.trend_report(periods)).collect()]
    assert text[0] == "## distance" and len(text) == 14
    ranked = reports.importance_rank(selection.feature_importance(df))
    sinks.write_importance(ranked, str(tmp_path / "importance"))
    table = [r[0] for r in spark.read.text(str(tmp_path / "importance" / "importance_md")).collect()]
    assert table[0] == "# Features by weight" and table[4].startswith("| 1 | ") and len(table) == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "importance" / "importance_csv")).count() == 2


def test_ingest_equals_batch_and_runs_once(spark, export, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.csv").write_text(EXPORT)
    (inbox / "b.csv").write_text("id,start_date,type,distance_km,total_time\n1,2024-01-01,Run,5,1800\n")
    (inbox / "c.txt").write_text("no csv")
    (inbox / "d.csv").write_text("id,type\n1,Run\n")
    log = {r["source"].rsplit("/", 1)[-1]: r for r in ingest.ingest(spark, str(inbox), out, f"{out}/cp", 2).collect()}
    assert {k: r["status"] for k, r in log.items()} == {"a.csv": "success", "b.csv": "success", "c.txt": "error", "d.csv": "error"}
    assert "essential" in log["d.csv"]["error_message"] and log["a.csv"]["rows_in"] == 4
    flow.write_stages(activities.read_activities(spark, export), str(tmp_path / "batch"))
    same(
        spark.read.parquet(f"{out}/uploads/{log['a.csv']['upload_id']}/tabular"),
        spark.read.parquet(str(tmp_path / "batch" / "tabular")),
    )
    (inbox / "e.csv").write_text(EXPORT)
    again = ingest.ingest(spark, str(inbox), out, f"{out}/cp", 2)
    assert again.count() == 5


def test_rows_without_date_or_runner_are_kept(spark):
    rows = [(1, "a", datetime(2024, 1, 1), 5.0, 600.0), (2, "a", None, 5.0, 600.0), (3, None, datetime(2024, 1, 1), 5.0, 600.0)]
    df = spark.createDataFrame(rows, "activity_id long, runner_id string, date timestamp_ntz, distance double, moving_time double")
    out = {r["activity_id"]: r for r in flow.tabular(df).collect()}
    assert [out[i]["runner_id"] for i in (1, 2, 3)] == ["01", "01", None]
    assert [out[i]["7d_run_count"] for i in (1, 2, 3)] == [1, None, None]
    assert out[2]["pace"] == "2'00\"" and out[2]["pace_previous"] == ""


def test_folder_of_exports_with_other_column_orders_and_line_breaks(spark, tmp_path):
    (tmp_path / "a b%1.csv").write_text('Activity ID,Description,Distance,Elapsed Time\n1,"two\nlines",5,300\n2,one,6,400\n')
    (tmp_path / "b.csv").write_text("Activity ID,Elapsed Time,Distance,Notes\n3,500,7,x\n")
    df = activities.read_activities(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("Activity ID", "Distance", "Elapsed Time", "Notes").collect())
    assert got == [("1", "5", "300", None), ("2", "6", "400", None), ("3", "7", "500", "x")]


def test_records_over_line_ends_are_read_by_many_tasks(spark, tmp_path):
    """Fields with line breaks, quotes and blanks, with block borders at every place, like the one-task reader."""
    rnd = random.Random(5)
    pieces = ["a", "\n", '""', ",", " ", "é", "\n\n", "x" * 30]
    lines = ["Activity ID,Description,Distance"]
    for i in range(120):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        lines.append(f'{i},"{text}",{i % 7}' if i % 3 else f"{i},plain,{i % 7}")
    lines.append('120,"' + "long\n" * 400 + '",1')
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    names = ["Activity ID", "Description", "Distance"]
    fields = "`Activity ID` string, Description string, Distance string"
    want = spark.read.schema(fields).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "x.csv"))
    want = sorted(tuple(r) for r in want.select(*[f"`{n}`" for n in names]).collect())
    assert len(want) == 121
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (128 * 1024 * 1024, 997, 310, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = activities.read_activities(spark, str(tmp_path / "x.csv"))
            got = sorted(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
            assert got == want, size
            tasks = activities._lines(spark, str(tmp_path / "x.csv")).select("block").distinct().count()
            assert tasks >= 1 if size > 10_000 else tasks > 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_months_of_a_table_without_dates(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "activity_id long, date timestamp_ntz")
    assert selection.trailing_months(df, 3).count() == 2


def test_latest_run_of_a_table_without_dates_is_its_first_row(spark):
    df = spark.createDataFrame([(2, None), (1, None)], "activity_id long, date timestamp_ntz")
    assert [r["activity_id"] for r in selection.latest_run(df).collect()] == [1]
    assert [r["activity_id"] for r in selection.latest_run(df.drop("date")).collect()] == [1]


def test_unreadable_dates(spark):
    df = spark.createDataFrame([("2024-01-02",), ("never",), (None,)], "date string")
    assert cleaning.parse_dates(df).filter("date is null").count() == 2
    with pytest.raises(Exception, match="unreadable date: never"):
        cleaning.parse_dates(df, strict=True).collect()


def test_raw_export_with_text_ids_runs_in_number_order(spark, tmp_path):
    head = "Activity ID,Activity Date,Activity Type,Distance,Elapsed Time,Athlete ID,Average Heart Rate,Moving Time\n"
    rows = [f"{i},2024-01-01 08:00:00,Run,{d},1800,{a},150,1500\n" for i, d, a in ((10, 6, 77), (9, 5, 77), (100, 7, 8))]
    (tmp_path / "x.csv").write_text(head + "".join(rows))
    raw = activities.read_activities(spark, str(tmp_path / "x.csv"))
    out = {r["activity_id"]: r for r in flow.run(raw).collect()}
    assert {i: (r["runner_id"], r["distance_previous"]) for i, r in out.items()} == {
        "9": ("01", None), "10": ("01", 5.0), "100": ("02", None)
    }
