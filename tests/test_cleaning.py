import pytest
from pyspark.sql import functions as F

from paceforge import schema
from paceforge.operators import cleaning, imputation

HEADER = ["Activity ID", "Activity Date", "Activity Type", "Distance", "Elapsed Time", "Average Heart Rate", "Device"]


def raw(spark, rows, header=HEADER):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def test_names():
    assert schema.normalise_name("  Max. Heart  Rate (bpm) ") == "max_heart_rate_bpm"
    assert schema.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    assert schema.alias_mapping(["id", "avg_hr", "heart_rate_avg"]) == {
        "id": "activity_id",
        "avg_hr": "average_heart_rate",
    }


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`Avg HR` string, `Average Heart Rate` string, id string")
    out = cleaning.standardise_columns(df)
    assert sorted(out.columns) == ["activity_id", "average_heart_rate", "avg_hr"]
    assert out.first()["average_heart_rate"] == "2"


def test_rules(spark):
    rows = [
        ("1", "2024-01-01", "Run", "5", "1800", "150", "x"),
        ("2", "2024-01-01", "RUN", "0.5", "1", "31", "x"),
        ("3", "2024-01-01", "run", "99.9", "1800", "249", "x"),
        ("4", "2024-01-01", "Ride", "5", "1800", "150", "x"),
        ("5", "2024-01-01", None, "5", "1800", "150", "x"),
        ("6", "2024-01-01", "Run", "0", "1800", "150", "x"),
        ("7", "2024-01-01", "Run", "-1", "1800", "150", "x"),
        ("8", "2024-01-01", "Run", "100", "1800", "150", "x"),
        ("9", "2024-01-01", "Run", None, "1800", "150", "x"),
        ("10", "2024-01-01", "Run", "5", "0", "150", "x"),
        ("11", "2024-01-01", "Run", "5", None, "150", "x"),
        ("12", "2024-01-01", "Run", "5", "1800", "30", "x"),
        ("13", "2024-01-01", "Run", "5", "1800", "250", "x"),
        ("14", "2024-01-01", "Run", "5", "1800", None, "x"),
        ("15", "2024-01-01", "Run", "nan", "1800", "150", "x"),
        ("16", "2024-01-01", "Run", "5", "1800", "Infinity", "x"),
    ]
    out = cleaning.clean(raw(spark, rows))
    assert out.columns == [
        "activity_id", "runner_id", "date", "activity_type", "distance", "elapsed_time", "average_heart_rate",
    ]
    got = {r["activity_id"]: r for r in out.collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["runner_id"] == schema.DEFAULT_RUNNER
    assert dict(out.dtypes)["date"] == "timestamp_ntz" and dict(out.dtypes)["distance"] == "double"

    typed = cleaning.standardise_columns(raw(spark, rows)).transform(cleaning.coerce_numeric)
    audit = cleaning.audit(typed).first().asDict()
    assert audit["rows_in"] == 16 and audit["rows_out"] == 3
    assert audit["rows_in"] - audit["rows_out"] == sum(v for k, v in audit.items() if k.startswith("rejected"))


def test_keep_missing_heart_rate(spark):
    rows = [
        ("1", "2024-01-02", "Run", "5", "1800", None, "x"),
        ("2", "2024-01-01", "Run", "5", "1800", "140", "x"),
        ("3", "2024-01-03", "Run", "5", "1800", "150", "x"),
    ]
    out = cleaning.clean(raw(spark, rows), keep_missing_hr=True)
    assert {r["activity_id"]: r["average_heart_rate"] for r in out.collect()} == {"1": 140.0, "2": 140.0, "3": 150.0}


@pytest.mark.parametrize("missing", ["Activity Date", "Distance", "Elapsed Time"])
def test_missing_essential_column(spark, missing):
    df = raw(spark, [("1", "2024-01-01", "Run", "5", "1800", "150", "x")]).drop(missing)
    with pytest.raises(ValueError, match="essential"):
        cleaning.clean(df)


def test_dates(spark):
    texts = ["2024-03-01T10:00:00", "2024-03-01", "3/1/2024 10:05", "Mar 1, 2024, 10:05:06 PM", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, date string")
    got = [None if r[0] is None else r[0].isoformat() for r in cleaning.parse_dates(df).orderBy("i").select("date").collect()]
    assert got == [
        "2024-03-01T10:00:00", "2024-03-01T00:00:00", "2024-03-01T10:05:00", "2024-03-01T22:05:06", None, None,
    ]


def test_dense_runner_ids_beyond_99(spark):
    df = spark.range(250).select(
        F.col("id").alias("activity_id"), F.concat(F.lit("r"), (249 - F.col("id")) % 120).alias("runner_id")
    )
    df = df.unionByName(spark.createDataFrame([(999, None)], "activity_id long, runner_id string"))
    got = {r["activity_id"]: r["runner_id"] for r in cleaning.dense_runner_ids(df).collect()}
    assert got[0] == "01" and got[9] == "10" and got[99] == "100" and got[119] == "120"
    assert got[120] == "01" and got[999] is None and len(got) == 251


def test_modes_and_means(spark):
    df = spark.createDataFrame(
        [("b", 1.0, None), ("b", 3.0, None), ("a", None, None), ("a", float("nan"), None), (None, 5.0, None)],
        "c string, x double, e string",
    )
    assert imputation.fit_modes(df, ["c", "e"]) == {"c": "a", "e": ""}
    filled = imputation.impute_median(df, ["x"]).select("x").collect()
    assert [r[0] for r in filled] == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert imputation.null_profile(df, ["c"]).first().asDict() == {
        "column_name": "c", "null_count": 1, "null_ratio": 0.2,
    }


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id int, start_day string, v double")
    assert schema.find_date_column(df) == "start_day"
    assert schema.drop_non_numeric(df).columns == ["id", "v"]
    with pytest.raises(ValueError):
        schema.find_date_column(df.select("id"))
    columns = ["distance", "pace_previous", "pace_diff", "elapsed_time", "average_speed", "pace", "pace_t-1", "pace_minutes"]
    assert schema.select_features(columns) == ["distance"]
    assert schema.select_features(columns, pace_history=True, direct_time=True) == [
        "distance", "pace_previous", "elapsed_time", "pace_t-1",
    ]
    assert schema.order_tabular(["zzz", "pace", "activity_id"]) == ["activity_id", "pace", "zzz"]
    assert schema.order_features(["30d_avg_x", "zzz", "7d_avg_x", "date"]) == ["date", "7d_avg_x", "30d_avg_x", "zzz"]
