import datetime as dt

from pyspark.sql import functions as F

from helpers import collected, series
from sparkcast.operators import calendar, clean

K = ["series_id"]


def with_holidays(spark, days, start, named):
    df = series(spark, range(days), start=start)
    name = F.lit("no")
    for day, value in named.items():
        name = F.when(F.col("ds") == F.lit(day), value).otherwise(name)
    return df.withColumn("public_holiday", name)


def test_later_holiday_wins_where_two_overlap(spark):
    first, second = dt.date(2020, 6, 10), dt.date(2020, 6, 15)
    df = with_holidays(spark, 30, dt.date(2020, 6, 1), {first: "A", second: "Karfreitag"})
    out = collected(calendar.add_holiday_counters(df, K)).set_index("ds")["cal_PublicHoliday_Counter"]
    assert out[dt.date(2020, 6, 2)] == 99
    assert out[dt.date(2020, 6, 3)] == 7
    assert out[dt.date(2020, 6, 8)] == 7  # the later holiday is seven days off
    assert out[dt.date(2020, 6, 12)] == 3
    assert out[dt.date(2020, 6, 18)] == -3
    assert out[dt.date(2020, 6, 19)] == 99


def test_special_days_have_their_own_counter(spark):
    df = with_holidays(spark, 30, dt.date(2020, 4, 1), {dt.date(2020, 4, 10): "Karfreitag", dt.date(2020, 4, 13): "X"})
    out = collected(calendar.add_holiday_counters(df, K)).set_index("ds")
    assert out.loc[dt.date(2020, 4, 13), "cal_Karfreitag_Counter"] == -3
    assert out.loc[dt.date(2020, 4, 13), "cal_PublicHoliday_Counter"] == 0
    assert (out["cal_Valentine_Counter"] == 99).all()
    assert "public_holiday" not in out.columns


def test_sparse_lags_equal_the_range_for_the_same_days(spark):
    df = with_holidays(spark, 60, dt.date(2020, 1, 1), {dt.date(2020, 1, 20): "A", dt.date(2020, 1, 24): "B"})
    dense = collected(calendar.add_holiday_counters(df, K, event_lags=range(-7, 4)))
    two = calendar.add_holiday_counters(df, K, event_lags=[-7, -6, -5, -4, -3, -2, 0, 1, 2, 3])
    out = collected(two)
    same = [d not in (dt.date(2020, 1, 19), dt.date(2020, 1, 23)) for d in out["ds"]]
    assert (dense["cal_PublicHoliday_Counter"][same] == out["cal_PublicHoliday_Counter"][same]).all()


def test_mothers_day_and_valentine(spark):
    out = collected(calendar.add_special_days(with_holidays(spark, 1100, dt.date(2020, 1, 1), {}))).set_index("ds")
    names = out["public_holiday"]
    assert [d for d in names.index if names[d] == "MothersDay"] == [
        dt.date(2020, 5, 10), dt.date(2021, 5, 9), dt.date(2022, 5, 8)]
    assert [d for d in names.index if names[d] == "Valentine"] == [
        dt.date(2020, 2, 14), dt.date(2021, 2, 14), dt.date(2022, 2, 14)]


def test_working_day_ignores_days_added_later(spark):
    df = with_holidays(spark, 20, dt.date(2020, 2, 10), {dt.date(2020, 2, 18): "A"})
    df = df.withColumn("public_holiday", F.when(F.dayofmonth("ds") == 19, None).otherwise(F.col("public_holiday")))
    out = collected(calendar.add_calendar_features(df, K)).set_index("ds")["cal_date_workingday"]
    assert out[dt.date(2020, 2, 14)]
    assert not out[dt.date(2020, 2, 16)]  # Sunday
    assert not out[dt.date(2020, 2, 18)]
    assert out[dt.date(2020, 2, 19)]  # unknown counts as no holiday


def test_one_hot_has_all_zero_for_null(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "series_id string, kind string")
    assert clean.categories_of(df, ["kind"]) == {"kind": ["x", "y"]}
    out = clean.one_hot(df, {"kind": ["y", "x"]}).orderBy("series_id").collect()
    assert out[0].asDict() == {"series_id": "a", "kind_x": 1, "kind_y": 0}
    assert out[2].asDict() == {"series_id": "c", "kind_x": 0, "kind_y": 0}
