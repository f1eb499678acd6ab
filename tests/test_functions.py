import datetime as dt

from pyspark.sql import functions as F

from staffwise.functions import clean, dates, mathx, text


def test_numeric_and_percent(spark):
    df = spark.createDataFrame([("1,234",), ("2.06%",), ("n/a",), (None,), (" 7 ",)], "s string")
    got = [r[0] for r in df.select(clean.numeric("s")).collect()]
    assert got == [1234.0, 2.06, None, None, 7.0]
    assert df.select(clean.percent("s")).first()[0] == 12.34


def test_day_first_dates_and_sundays(spark):
    df = spark.createDataFrame([("17-08-2025",), ("18/8/2025",), ("2025-08-17",), ("bad",)], "s string")
    d = [r[0] for r in df.select(dates.lenient_day("s")).collect()]
    assert d == [dt.date(2025, 8, 17), dt.date(2025, 8, 18), dt.date(2025, 8, 17), None]
    x = spark.createDataFrame([(dt.date(2025, 8, 17),), (dt.date(2025, 8, 18),), (dt.date(2024, 1, 1),),
                               (dt.date(2023, 12, 31),)], "d date")
    r = x.select(dates.sunday_on_or_before("d"), dates.sunday_strictly_before("d"),
                 dates.week_of_year_sunday("d")).collect()
    assert (r[0][0], r[0][1]) == (dt.date(2025, 8, 17), dt.date(2025, 8, 10))
    assert (r[1][0], r[1][1]) == (dt.date(2025, 8, 17), dt.date(2025, 8, 17))
    assert [row[2] for row in r] == [33, 33, 0, 53]


def test_labels(spark):
    df = spark.createDataFrame([("USD OCC Assumptions (L3):",), ("Combined OCC Assumptions (Combined):",),
                                ("OCC Assumptions (L3):",), ("no parens",), ("Global x (ACTUAL)",)], "s string")
    r = df.select(text.level_in_parens("s"), text.category_of_label("s")).collect()
    assert [tuple(x) for x in r] == [("L3", "USD"), ("Combined", "Combined"), ("L3", None), (None, None),
                                     (None, "Global")]
    lv = spark.createDataFrame([("l4 - msi",), ("X",)], "s string").select(text.level_of_text("s")).collect()
    assert [x[0] for x in lv] == ["L4", "Other"]
    m = spark.createDataFrame([("1. Weekly Planner OPI",), ("x",)], "s string").select(text.after_marker("s"))
    assert [x[0] for x in m.collect()] == ["OPI", None]


def test_caps_keep_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.5,), (0.5,)], "x double")
    assert [r[0] for r in df.select(mathx.cap("x", 1.0)).collect()] == [None, None, 1.0, 0.5]


def test_safe_delta(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0), (2.0, None), (None, 1.0)], "n double, o double")
    assert [r[0] for r in df.select(clean.safe_delta("n", "o")).collect()] == [1.0, 0.0, 0.0, None]


def test_stable_rounding_drops_negative_zero(spark):
    df = spark.createDataFrame([(-1e-12,), (0.1234567891,), (123456.78951,)], "x double")
    r = [x[0] for x in df.select(mathx.stable(F.col("x"))).collect()]
    assert r == [0.0, 0.123457, 123456.78951]  # six decimals at every magnitude
    assert str(r[0]) == "0.0"
