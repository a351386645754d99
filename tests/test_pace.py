from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceforge.operators import paces
from paceforge.functions import calendar, pace


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_parse_vectors(spark):
    texts = ["7'03\"", "7:03", "7:30:15", "6.5", "abc", "7'", "", None, "-1'30\"", "nan", "inf", "1.5d", "7'x\"", " 7 : 30"]
    want = [7.05, 7.05, 7.5, 6.5, None, None, None, None, -0.5, None, None, None, None, 7.5]
    assert all(map(close, column(spark, texts, "string", pace.parse), want))


def test_parse_signed_vectors(spark):
    texts = ["-1'30\"", "1'30\"", "-2:15", "-3.5", "3.5", "", None]
    want = [-1.5, 1.5, -2.25, -3.5, 3.5, None, None]
    assert all(map(close, column(spark, texts, "string", pace.parse_signed), want))


def test_parse_target_vectors(spark):
    texts = ["7'30\"", "7'30.6\"", "7:30", "7.5", None]
    want = [7.5, 7.51, None, None, None]
    assert all(map(close, column(spark, texts, "string", pace.parse_target), want))


def test_format_vectors(spark):
    minutes = [7.05, 6.999, 12.5, 0.0, None, float("nan"), float("inf")]
    assert column(spark, minutes, "double", pace.to_prime) == ["7'03\"", "7'00\"", "12'30\"", "0'00\"", "", "", ""]
    signed = [-1.5, 1.5, -0.25, None, float("-inf")]
    assert column(spark, signed, "double", pace.to_colon) == ["-1:30", "1:30", "-0:15", "", ""]
    assert column(spark, [-1.5, 0.5], "double", pace.to_prime) == ["-1'30\"", "0'30\""]


def test_half_seconds_round_to_even(spark):
    minutes = [5 + 0.5 / 60 * k for k in (1, 3)]  # 0.5 s and 1.5 s, exact in floating point or not
    got = column(spark, minutes, "double", pace.to_colon)
    want = [f"5:{round((m - 5) * 60):02d}" for m in minutes]
    assert got == want


def test_truncating_display_vectors(spark):
    minutes = [7.8, 5.733333333333333, 6.35, 9.133333333333333, None]
    want = ["7:47", "5:44", "6:20", "9:07", None]
    got = column(spark, minutes, "double", pace.to_colon_truncated)
    reference = [None if m is None else f"{int(m)}:{int((m % 1) * 60):02d}" for m in minutes]
    assert got == reference
    assert got[0] == want[0] and got[-1] is None


def test_every_finite_number_has_a_text(spark):
    values = [1e15, -1e15, 1e18, -1.5e300, 999999999999999.0, float("inf"), float("nan"), None]
    want = ["1" + "0" * 15, "-1" + "0" * 15, "1" + "0" * 18, "-15" + "0" * 299, "9" * 15]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for tail, texts in (
        ("'00\"", [r[0] for r in df.orderBy("i").select(pace.to_prime(F.col("x"))).collect()]),
        (":00", [r[0] for r in df.orderBy("i").select(pace.to_colon(F.col("x"))).collect()]),
        ("'00\"", [r["x"] for r in paces.render(df, ["x"]).orderBy("i").collect()]),
    ):
        assert texts == [w + tail for w in want] + ["", "", ""]
    cut = [r[0] for r in df.orderBy("i").select(pace.to_colon_truncated(F.col("x"))).collect()]
    assert cut == [w + ":00" for w in want] + [None, None, None]


def test_pace_sources(spark):
    df = spark.createDataFrame([(600.0, 2.0), (600.0, 0.0), (None, 1.0)], "t double, d double")
    assert [r[0] for r in df.select(pace.from_time(F.col("t"), F.col("d"))).collect()] == [5.0, None, None]
    got = column(spark, [10.0, 0.0, float("inf"), None], "double", pace.from_speed)
    assert got == [6.0, None, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 500, allow_nan=False), min_size=50, max_size=200))
def test_parse_undoes_format(spark, minutes):
    for fmt, read in ((pace.to_prime, pace.parse), (pace.to_colon, pace.parse_signed)):
        got = column(spark, minutes, "double", lambda c: read(fmt(c)))  # noqa: B023
        assert all(abs(g - m) <= 0.5 / 60 + 1e-9 for g, m in zip(got, minutes))


def test_week_bins(spark):
    days = [0, 7, 8, 14, 15, 91, 92]
    got = column(spark, days, "long", lambda c: calendar.week_bin(c))
    assert got == [1, 1, 2, 2, 3, 13, None]
    # fewer bins when the data covers less: 10 days give two weeks
    assert column(spark, [0, 10], "long", lambda c: calendar.week_bin(c, F.lit(10))) == [1, 2]
    assert column(spark, [21, 14], "long", lambda c: calendar.week_bin(c, F.lit(13))) == [None, 2]


def test_seconds_impact_rounds_away_from_zero(spark):
    got = column(spark, [0.0161, 0.0470, -0.0161, -0.5481, 0.0], "double", calendar.seconds_impact)
    assert got == [1, 3, -1, -33, 0]


def test_calendar(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-12-30 10:00:00' AS d UNION ALL SELECT timestamp_ntz'2024-06-01 00:00:00'"
    )
    got = df.orderBy("d").select(
        calendar.week_number(F.col("d")), calendar.day_of_week(F.col("d")), calendar.is_weekend(F.col("d"))
    ).collect()
    assert [tuple(r) for r in got] == [(22, 5, 1), (1, 0, 0)]
    parts = calendar.date_parts(F.col("d"))
    row = df.orderBy("d").select(*[c.alias(n) for n, c in parts.items()]).first()
    assert tuple(row) == (2024, 6, "June", 2, "2024-06", 22)
