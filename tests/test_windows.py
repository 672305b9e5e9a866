import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import close, collected, many, series
from sparkcast.operators import chunks, clean, lags

K = ["series_id"]


def noisy(n, seed=0, holes=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.gamma(2.0, 50.0, n), 2)
    return np.where(rng.random(n) < holes, np.nan, x)


def test_features_equal_pandas_and_do_not_depend_on_the_chunk_size(spark, monkeypatch):
    x = noisy(400)
    df = series(spark, x)
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 8)
    out = collected(lags.add_statistical_features(df, K, chunks.tick("ds"), ["y"], season=14, width_weekday=3))
    s = pd.Series(x)
    for i in range(1, 8):
        close(out[f"stat_y_lag{i}"], s.shift(i))
        close(out[f"stat_y_seaslag{i}"], s.shift(14 + i - 1))
    for name in ("mean", "median", "max"):
        close(out[f"stat_y_rolling_{name}7"], getattr(s.shift(1).rolling(7), name)())
        close(out[f"stat_y_rolling_seasonal_{name}7"], getattr(s.shift(15).rolling(7), name)())
    weekday = pd.Series(pd.to_datetime(out["ds"])).dt.weekday
    for day in range(7):
        part = s[weekday == day]
        close(out.loc[weekday == day, "stat_y_weekday_rolling_mean3"], part.shift(1).rolling(3).mean())


def test_seasonal_block_is_left_out_for_short_seasons(spark):
    df = series(spark, range(30))
    out = lags.add_statistical_features(df, K, chunks.tick("ds"), ["y"], season=7)
    assert not [c for c in out.columns if "rolling_seasonal" in c]


def test_non_seasonal_features_have_no_seasonal_columns(spark):
    df = many(spark, {"y": range(20), "temp": range(20)})
    out = lags.add_statistical_features(df, K, chunks.tick("ds"), ["y", "temp"], season=8, non_seasonal=["temp"])
    assert "stat_temp_lag1" in out.columns and "stat_temp_rolling_max7" in out.columns
    assert not [c for c in out.columns if c.startswith("stat_temp_seas") or "temp_weekday" in c or "temp_rolling_seas" in c]


def test_no_feature_looks_ahead(spark):
    x = noisy(120, holes=0.0)
    y = x.copy()
    y[80] += 1000.0
    build = lambda v: collected(lags.add_statistical_features(series(spark, v), K, chunks.tick("ds"), ["y"], 14))
    a, b = build(x), build(y)
    made = [c for c in a.columns if c.startswith("stat_")]
    pd.testing.assert_frame_equal(a.loc[:80, made], b.loc[:80, made])


def test_ordinals_and_running_sums_of_a_key_with_most_rows(spark):
    hot = series(spark, noisy(3000, 1, 0.0), "hot").filter(F.dayofmonth("ds") != 13)
    df = hot.unionByName(series(spark, noisy(40, 2, 0.0), "cold"))
    rows = chunks.with_ordinal(df, K, size=16)
    out = collected(chunks.running_sums(rows, K, "t", {"s": F.col("y")}, {"all": F.col("y")}, size=16))
    for key, part in out.groupby("series_id"):
        assert list(part["t"]) == list(range(len(part)))
        assert set(part["n_rows"]) == {len(part)}
        close(part["s"], part["y"].cumsum().shift(1).fillna(0.0), 1e-7)
        close(part["all"], np.full(len(part), part["y"].sum()), 1e-7)


def test_no_task_holds_a_long_series(spark):
    df = chunks.windowed(series(spark, range(5000)), K, chunks.tick("ds"),
                         lambda make: {"n": F.count("y").over(make().rowsBetween(-10**6, 10**6))}, back=7, size=64)
    assert collected(df)["n"].max() <= 64 + 7


def test_regularize_daily_weekly_and_hourly(spark):
    df = series(spark, [1, 2, 3, 4]).filter(F.dayofmonth("ds") != 3)
    out = collected(clean.regularize(df, K))
    assert len(out) == 4 and np.isnan(out["y"][2])
    weekly = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 1, 19), 3.0)],
                                   "series_id string, ds date, y double")
    assert len(collected(clean.regularize(weekly, K, freq="W"))) == 3
    hourly = spark.createDataFrame([("a", dt.datetime(2020, 1, 5, 1), 1.0), ("a", dt.datetime(2020, 1, 5, 4), 3.0)],
                                   "series_id string, ds timestamp, y double")
    assert len(collected(clean.regularize(hourly, K, freq="H"))) == 4


def test_weekly_resampling(spark):
    df = many(spark, {"y": [1, 2, 3, 4, 5, None, None, 8], "m": [1, 1, 1, 1, 1, 4, None, 8]}, start=dt.date(2020, 1, 1))
    out = collected(clean.resample_weekly(df, K, ["y"]))
    assert list(out["ds"]) == [dt.date(2020, 1, 5), dt.date(2020, 1, 12)]
    close(out["y"], [15.0, 8.0])
    close(out["m"], [1.0, 6.0])


def test_week_without_values_is_dropped_only_for_a_missing_average(spark):
    df = many(spark, {"y": [None] * 7 + [1.0] * 7, "m": [1.0] * 14}, start=dt.date(2020, 1, 6))
    close(collected(clean.resample_weekly(df, K, ["y"]))["y"], [0.0, 7.0])
    df = many(spark, {"y": [None] * 7 + [1.0] * 7, "m": [None] * 7 + [1.0] * 7}, start=dt.date(2020, 1, 6))
    close(collected(clean.resample_weekly(df, K, ["y"]))["y"], [7.0])


def test_differencing_and_its_inverse(spark):
    x = noisy(60, 3, 0.0)
    rows = lags.difference(series(spark, x), K, chunks.tick("ds"), "y", d=1, seasonal_d=1, season=7, name="w")
    back = chunks.windowed(rows, K, chunks.tick("ds"), lambda make: {
        "z": lags.undo_difference(F.col("w"), lambda i: F.lag("y", i).over(make()), 1, 1, 7)}, back=8)
    out = collected(back)
    s = pd.Series(x)
    close(out["w"], s.diff().diff(7))
    close(out["z"][8:], s[8:], 1e-7)


def test_sequences_keep_missing_values(spark):
    rows = chunks.with_ordinal(many(spark, {"y": range(6), "z": [0, None, 2, 3, 4, 5]}), K)
    out = collected(lags.sequence_windows(rows, K, "t", ["y", "z"], "y", 3))
    assert len(out) == 3 and list(out["label"]) == [3.0, 4.0, 5.0]
    assert [list(r) for r in out["seq"][0]][1] == [1.0, None] or np.isnan(out["seq"][0][1][1])
