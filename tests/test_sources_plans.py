import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import close, collected, many, series
from sparkcast.operators import grid, profile, transform
from sparkcast.plans import prepare
from sparkcast.sources import results
from sparkcast.sources import series as sources

K = ["series_id"]


def test_text_source_with_decimal_comma(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "Date;sales;flag;public_holiday\n07.02.2020;1,5;True;no\n08.02.2020;;False;Karfreitag\n2020-02-09;-2,25;nan;no\n")
    rows = sources.read_series_csv(spark, str(tmp_path / "in.csv")).orderBy("ds").collect()
    assert [r["ds"] for r in rows] == [dt.date(2020, 2, 7), dt.date(2020, 2, 8), dt.date(2020, 2, 9)]
    assert [r["sales"] for r in rows] == [1.5, None, -2.25]
    assert [r["flag"] for r in rows] == [1.0, 0.0, None]
    assert rows[1]["public_holiday"] == "Karfreitag"


def test_results_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456789012, 3)], "dataset string, rmse double, run int").coalesce(1)
    results.write_results_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text == ["dataset;rmse;run", "a;1,2345678901;3"]
    back = sources.read_series_csv(spark, str(tmp_path / "out"), text_columns=["dataset"], date_column="run")
    assert np.isclose(back.first()["rmse"], 1.2345678901)
    assert results.result_name("XGB", "Sold", ["D"], ["mean", None], 0.8, 7, "now", ["full"]) == (
        "XGB-Sold-D-feat_full-imp_mean_None-splitperc_08-SeasPer_7-now")


def test_parquet_sink_is_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("xgb", "y", "d", 1.0)], "algo string, target string, dataset string, rmse double")
    results.write_results(df, str(tmp_path / "res"))
    assert (tmp_path / "res" / "algo=xgb" / "target=y" / "dataset=d").is_dir()


def test_datasets_with_a_break(spark):
    df = sources.load_datasets(series(spark, range(10)), "d", dt.date(2020, 1, 6))
    counts = {r["dataset"]: r["count"] for r in df.groupBy("dataset").count().collect()}
    assert counts == {"d": 10, "d_before_break": 5}


def test_run_parameters():
    config = sources.SeriesConfig("y", "d", 365, resample_weekly=True)
    assert sources.RunParameters.of(config, 0.8) == sources.RunParameters(52, 0.8, None, None, True)
    assert sources.RunParameters.of(config, 0) == sources.RunParameters(52, None, 730, 365, True)


def test_kernels_and_grid(spark):
    base = spark.createDataFrame([("d",)], "dataset string")
    kernels = grid.kernel_combinations(base)
    assert kernels.count() == 344 and kernels.select("kernel").distinct().count() == 344
    values = {"imputation": ["mean", None, "knn"], "featureset": ["full", "none"], "dim_reduction": ["None", "pca"]}
    whole = grid.param_grid(base, values)
    assert whole.count() == grid.grid_size(values) == 12
    assert sorted(r["cfg_id"] for r in whole.collect()) == list(range(12))
    kept = {(r["imputation"], r["featureset"], r["dim_reduction"]) for r in grid.prune_grid(whole, False).collect()}
    assert ("knn", "none", "None") not in kept and ("mean", "none", "pca") not in kept
    assert (None, "full", "pca") not in kept and (None, "none", "None") in kept
    assert ("knn", "none", "None") in {tuple(r)[1:4] for r in grid.prune_grid(whole, True).collect()}


def test_log_transform(spark):
    df = series(spark, [0, 1, 2]).unionByName(series(spark, [1, 2, 4], "b"))
    out = collected(transform.log_transform(df, K, "y"))
    close(out["y"], [*np.log1p([0, 1, 2]), *np.log([1, 2, 4])])
    with pytest.raises(Exception, match="negative"):
        transform.log_transform(series(spark, [-1, 2]), K, "y").collect()


def test_power_transform_finds_the_likeliest_lambda(spark):
    x = np.random.default_rng(0).lognormal(1.0, 0.6, 400)
    lam = transform.power_lambda(series(spark, x), K, "y").first()["power"]

    def likelihood(p):
        z = np.log1p(x) if abs(p) < 1e-12 else ((x + 1) ** p - 1) / p
        return -len(x) / 2 * np.log(z.var()) + (p - 1) * np.log1p(x).sum()

    fine = max(np.arange(-2, 4, 0.005), key=likelihood)
    assert abs(lam - fine) < 0.03
    both = spark.createDataFrame([(-2.5,), (-0.5,), (0.0,), (3.0,)], "x double")
    for p in (-0.5, 0.0, 1.3, 2.0):
        z = both.withColumn("z", transform.yeo_johnson(F.col("x"), F.lit(p)))
        back = z.withColumn("b", transform.yeo_johnson_inverse(F.col("z"), F.lit(p))).toPandas()
        close(back["b"], back["x"])


def test_standardize_constant_column(spark):
    out = collected(transform.standardize(series(spark, [3, 3, 3]), K, ["y"]))
    close(out["y"], [0, 0, 0])


def test_autocorrelation_and_histogram(spark):
    x = np.random.default_rng(1).normal(0, 1, 200)
    out = collected(profile.autocorrelation(series(spark, x), K, "y", 70, block=32), "lag")
    c = x - x.mean()
    close(out["r"], [(c[:-h] * c[h:]).sum() / (c * c).sum() for h in range(1, 71)])
    counts, edges = np.histogram(x, 10)
    got = collected(profile.histogram(series(spark, x), K, ["y"]), "bin")
    assert list(got["n"]) == list(counts)
    close(got["upper"], edges[1:])
    counts, _ = np.histogram(x, [-1, 0, 0.5, 2])
    assert list(collected(profile.histogram(series(spark, x), K, ["y"], [-1, 0, 0.5, 2]), "bin")["n"]) == list(counts)
    flat = collected(profile.histogram(series(spark, [2, 2]), K, ["y"]), "bin")
    assert list(flat["n"]) == list(np.histogram([2, 2], 10)[0])


def holiday_frame(spark, n=200):
    rng = np.random.default_rng(0)
    y = np.round(rng.gamma(3, 20, n), 1)
    y[::9] = np.nan
    rows = many(spark, {"y": y, "z": np.round(rng.gamma(3, 20, n), 1), "temp": rng.normal(10, 3, n)})
    return rows.withColumns({
        "public_holiday": F.when(F.dayofmonth("ds") == 1, "X").otherwise("no"),
        "school_holiday": F.when(F.month("ds") == 4, "oster").otherwise("no")})


CONFIG = sources.SeriesConfig("y", "d", 14, ("y", "z", "temp"), ("y", "z"), non_seasonal=("temp",))
CATEGORIES = {"public_holiday": ["X", "no"], "school_holiday": ["oster", "no"]}


@pytest.mark.parametrize("featureset", prepare.FEATURESETS)
def test_prepared_columns_by_feature_set(spark, featureset):
    out = prepare.prepare_dataset(holiday_frame(spark), K, CONFIG, sources.RunParameters.of(CONFIG, 0.8), "mean",
                                  featureset, CATEGORIES)
    names = set(out.columns)
    assert ("cal_date_weekday" in names) == (featureset in ("full", "cal"))
    assert ("stat_y_lag1" in names) == (featureset in ("full", "stat"))
    assert ("public_holiday_X" in names) == (featureset in ("none", "stat"))
    assert "school_holiday_oster" in names and "z" not in names
    pdf = collected(out)
    assert len(pdf) == 200 and (pdf["split"] == "train").sum() == 160
    assert not pdf.drop(columns=["ds"]).isna().any().any()


def test_prepared_folds_learn_from_their_own_train_rows(spark):
    params = sources.RunParameters.of(CONFIG, 0)
    out = collected(prepare.prepare_dataset(holiday_frame(spark), K, CONFIG, params, "mean", "none", CATEGORIES))
    raw = collected(holiday_frame(spark))["y"]
    for fold, part in out.groupby("fold"):
        end = 28 + 14 * fold
        assert len(part) == min(end + 14, 200)
        close(part["y"].iloc[0], raw[:end].mean())


def test_weekly_preparation(spark):
    config = sources.SeriesConfig("y", "d", 28, ("y", "z"), ("y", "z"), resample_weekly=True)
    params = sources.RunParameters.of(config, 0.75)
    out = collected(prepare.prepare_dataset(holiday_frame(spark, 400).drop("temp"), K, config, params, "mean", "full", CATEGORIES))
    assert {"stat_y_lag4", "stat_y_rolling_mean4", "stat_y_rolling_mean2", "stat_y_rolling_seasonal_max2"} <= set(out.columns)
    assert "stat_y_rolling_seasonal_mean4" not in out.columns  # the weekly season is not above the width
    assert "cal_date_weekday" not in out.columns and "stat_y_lag2" not in out.columns
    weeks = len(out)
    assert (out["split"] == "train").sum() == int(weeks * 0.75)


def test_registered_queries_match_their_sql(spark):
    """A few registered queries against DuckDB on the smallest tables; tools/check.py runs all."""
    import os
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry_points

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    db = duckdb.connect()
    for name in ("orders", "customer", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    for name in ("evaluate_baselines", "tssplit", "holiday_counters", "rolling_stats"):
        frame = queries[name](spark, sf)
        columns = sorted(frame.columns)
        got = sorted(map(str, frame.select(columns).collect()))
        names = ", ".join(f'"{c}"' for c in columns)
        want = db.execute(f"SELECT {names} FROM ({oracles[name]})").fetchall()
        from pyspark.sql import Row
        assert got == sorted(str(Row(*columns)(*r)) for r in want), name
    assert entry_points.entry(spark).count() > 0
