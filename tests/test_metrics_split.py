import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import close, collected, series, split_at
from sparkcast.operators import baselines, clean, metrics, split

K = ["series_id"]


def pairs(spark, rows):
    rows = [tuple(None if v is None else float(v) for v in r) for r in rows]
    return spark.createDataFrame([("a", *r) for r in rows], "series_id string, actual double, prediction double")


def test_metrics_by_hand(spark):
    out = metrics.score(pairs(spark, [(10, 12), (0, 0), (5, None), (0, 3)]), K).first()
    assert out["n_scored"] == 3
    assert math.isclose(out["rmse"], math.sqrt((4 + 0 + 9) / 3))
    assert math.isclose(out["mape"], 100 * (2 / 10.1 + 0 + 3 / 0.1) / 3)
    assert math.isclose(out["smape"], 100 / 3 * (2 / 11 + 3 / 1.5))


def test_all_exact_zero_forecasts(spark):
    out = metrics.score(pairs(spark, [(0, 0), (0, 0)]), K).first()
    assert (out["rmse"], out["mape"], out["smape"]) == (0.0, 0.0, 0.0)


def test_missing_actual_leaves_no_metric_or_fails(spark):
    df = pairs(spark, [(None, 1), (2, 2)])
    assert metrics.score(df, K).first()["rmse"] is None
    with pytest.raises(Exception, match="missing values"):
        metrics.score(df, K, strict=True).collect()
    assert metrics.score(pairs(spark, [(None, None), (2, 2)]), K).first()["rmse"] == 0.0


def test_fold_mean_needs_every_fold_but_cv_skips_failed_ones(spark):
    rows = [("a", 0, 1.0, 1.0, 1.0), ("a", 1, None, None, None), ("b", 0, 1.0, 2.0, 3.0), ("b", 1, 3.0, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "series_id string, fold int, rmse double, mape double, smape double")
    mean = {r["series_id"]: r["rmse"] for r in metrics.mean_over_folds(df, K).collect()}
    assert mean == {"a": None, "b": 2.0}
    cv = {r["series_id"]: r for r in metrics.cv_summary(df, K, 2).collect()}
    assert cv["a"]["ts_cv_rmse_mean"] == 1.0 and cv["a"]["ts_cv_rmse_1"] is None
    assert cv["b"]["ts_cv_rmse_std"] == 1.0


def test_best_run_is_the_first_of_equals_and_never_missing(spark):
    rows = [("d", 2, 1.0), ("d", 1, 1.0), ("d", 3, None), ("e", 1, None), ("e", 2, 7.0)]
    df = spark.createDataFrame(rows, "dataset string, run int, rmse double")
    best = {r["dataset"]: r["run"] for r in metrics.best_runs(df, ["rmse"]).collect()}
    assert best == {"d": 1, "e": 2}


def test_percentage_split_truncates(spark):
    out = collected(split.percentage_split(series(spark, range(7)), K, 0.8))
    assert list(out["split"]) == ["train"] * 5 + ["test"] * 2


@pytest.mark.parametrize("n, initial, test", [(30, 10, 5), (23, 10, 4), (12, 10, 5), (9, 10, 5), (64, 14, 7)])
def test_expanding_split_equals_slicing(spark, n, initial, test):
    out = collected(split.expanding_split(series(spark, range(n)), K, initial, test), "t")
    for fold in range(math.ceil(n / (initial + test))):
        here = out[out["fold"] == fold]
        end = initial + fold * test
        assert list(here[here["split"] == "train"]["t"]) == list(range(min(end, n)))
        assert list(here[here["split"] == "test"]["t"]) == list(range(end, min(end + test, n)))
    assert out["fold"].max() == math.ceil(n / (initial + test)) - 1
    once = collected(split.test_folds(series(spark, range(n)), K, initial, test), "t")
    assert len(once) == n
    tested = out[out["split"] == "test"]
    assert sorted(zip(tested["fold"], tested["t"])) == sorted(
        (int(f), t) for f, t in zip(once["fold"], once["t"]) if f == f)


def test_all_folds_option(spark):
    out = collected(split.expanding_split(series(spark, range(23)), K, 10, 4, all_folds=True), "t")
    assert out["fold"].nunique() == 4
    assert sorted(out[out["split"] == "test"]["t"]) == list(range(10, 23))


def test_timeseries_cv_sizes(spark):
    df = series(spark, range(83)).unionByName(series(spark, range(79), "short"))
    out = collected(split.timeseries_cv(df, K), "t")
    assert set(out["series_id"]) == {"a"}
    sizes = out.groupby(["fold", "split"]).size()
    assert [sizes[(i, "test")] for i in range(3)] == [20, 20, 20]
    assert [sizes[(i, "train")] for i in range(3)] == [23, 43, 63]


def test_shuffle_cv_draws_the_same_rows_every_time(spark):
    df = series(spark, range(2503))
    a = collected(split.shuffle_cv(df, K), "t")
    b = collected(split.shuffle_cv(df.repartition(7), K), "t")
    assert a.equals(b)
    assert (a[a["split"] == "test"].groupby("fold").size() == math.ceil(0.2 * 2503)).all()


def test_baselines_by_hand(spark):
    rows = split_at(series(spark, [1, 2, None, 4, 5, 6, 7, 8]), 5)
    out = collected(baselines.one_step_baselines(rows, K, "y", 3), "t")
    close(out["RW"], [None, 1, 2, None, 4, 5, 6, 7])
    close(out["seasRW"], [None, None, None, 1, 2, None, 4, 5])
    close(out["HA"], [3, 3, 3, 3, 3, 12 / 4, 18 / 5, 25 / 6])
    close(collected(baselines.naive_fixed(rows, K, "y"), "t")["prediction"][5:], [5, 5, 5])
    close(collected(baselines.seasonal_naive_fixed(rows, K, "y", 2), "t")["prediction"][5:], [4, 5, 4])
    # fewer train rows than a season: what there is, over and over
    short = split_at(series(spark, [1, 2, 3, 4, 5, 6]), 2)
    close(collected(baselines.seasonal_naive_fixed(short, K, "y", 4), "t")["prediction"][2:], [1, 2, 1, 2])


def test_validation_cut_and_last_season(spark):
    rows = split.percentage_split(series(spark, range(25)), K, 0.8)
    out = collected(split.validation_cut(rows, K), "t")
    assert list(out["split"]) == ["train"] * 16 + ["valid"] * 4
    assert [int(v) for v in collected(split.last_season(rows, 3), "t")["y"]] == [17, 18, 19]


def test_interval_coverage(spark):
    df = metrics.with_interval(pairs(spark, [(1, 1.5), (5, 1), (None, 3)]), 1.0)
    row = metrics.interval_coverage(df, K).first()
    assert (row["coverage"], row["n_scored"]) == (0.5, 2)


def test_clean_helpers(spark):
    df = spark.createDataFrame([("a", 1.0, None, float("nan"))], "series_id string, x double, y double, z double")
    assert clean.condense(df, ["x", "y"], "s").first()["s"] is None
    assert clean.null_if_nan(df).first()["z"] is None
    assert [r["n_null"] for r in clean.null_counts(df, K, ["x", "y", "z"]).orderBy("column").collect()] == [0, 1, 1]
    assert df.select(clean.zero_if_missing(F.col("z")).alias("z")).first()["z"] == 0.0
    assert clean.drop_unpredicted(df.withColumn("prediction", F.lit(-9999.0)), dummy=-9999.0).count() == 0
    assert np.isclose(clean.drop_null_features(df, ["x", "y"]).first()["x"], 1.0)
    assert "y" not in clean.drop_null_features(df, ["x", "y"]).columns
