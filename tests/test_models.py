import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import close, collected, many, split_at
from sparkcast.models import arima, gp, gram, linear, pca, smoothing, trees
from sparkcast.plans import experiment

K = ["series_id"]


def regression(spark, n=120, d=3, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, d))
    w = np.array([2.0, 0.0, -1.0, 0.5])[:d]
    y = 4 + x @ w + rng.normal(0, noise, n)
    return x, y, split_at(many(spark, {**{f"x{i}": x[:, i] for i in range(d)}, "y": y}), 90)


def ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


def test_ridge_and_its_normalised_form(spark):
    x, y, df = regression(spark)
    names = ["x0", "x1", "x2"]
    configs = linear.grid_of("ridge", {"alpha": [0.5], "normalize": [False, True]})
    models = {r["cfg_id"]: r for r in linear.fit(df, K, names, "y", configs).collect()}
    w, b = ridge(x[:90], y[:90], 0.5)
    close(models[0]["coef"], w)
    assert np.isclose(models[0]["intercept"], b)
    norm = np.sqrt(((x[:90] - x[:90].mean(0)) ** 2).sum(0))
    w, b = ridge(x[:90] / norm, y[:90], 0.5)
    close(models[1]["coef"], w / norm)


def test_rolling_origin_equals_refits(spark):
    x, y, df = regression(spark)
    out = collected(linear.rolling_origin(df, K, ["x0", "x1", "x2"], "y", [linear.LinearConfig(alpha=0.5)]), "t")
    want = []
    for i in range(90, 120):
        w, b = ridge(x[:i], y[:i], 0.5)
        want.append(b + x[i] @ w)
    close(out["prediction"], want, 1e-8)


def test_rolling_origin_over_chunks(spark, monkeypatch):
    x, y, df = regression(spark)
    args = (df, K, ["x0", "x1", "x2"], "y", [linear.LinearConfig(alpha=0.5)])
    whole = collected(linear.rolling_origin(*args), "t")
    monkeypatch.setattr(gram, "CHUNK_ROWS", 16)
    close(collected(linear.rolling_origin(*args), "t")["prediction"], whole["prediction"], 1e-8)


def test_rolling_origin_with_many_features(spark, monkeypatch):
    x, y, df = regression(spark)
    df = df.withColumn("x1", F.when(F.col("t").isin(5, 95), None).otherwise(F.col("x1")))
    df = df.withColumn("y", F.when(F.col("t") == 100, None).otherwise(F.col("y")))
    args = (df, K, ["x0", "x1", "x2"], "y", linear.grid_of("ridge", {"alpha": [0.5, 5.0]}))
    narrow = collected(linear.rolling_origin(*args).orderBy("cfg_id"), "t")
    for name, value in (("MAX_JVM_SUMS", 1), ("CHUNK_ROWS", 16), ("WIDE_BATCH", 5)):
        monkeypatch.setattr(linear, name, value)
    wide = collected(linear.rolling_origin(*args).orderBy("cfg_id"), "t")
    assert len(wide) == 2 * 29
    a = narrow.sort_values(["cfg_id", "t"])["prediction"]
    close(wide.sort_values(["cfg_id", "t"])["prediction"], a, 1e-7)


@pytest.mark.parametrize("alpha, share", [(0.1, 1.0), (0.1, 0.3), (1.5, 0.7)])
def test_elastic_net_meets_its_optimality_conditions(spark, alpha, share):
    x, y, df = regression(spark)
    cfg = linear.LinearConfig("elasticnet", alpha=alpha, l1_ratio=share)
    r = linear.fit(df, K, ["x0", "x1", "x2"], "y", [cfg]).first()
    w = np.array(r["coef"])
    xc, yc = x[:90] - x[:90].mean(0), y[:90] - y[:90].mean()
    gradient = xc.T @ (yc - xc @ w) / 90 - alpha * (1 - share) * w
    for g, v in zip(gradient, w):
        assert np.isclose(g, alpha * share * np.sign(v), atol=1e-5) if v else abs(g) <= alpha * share + 1e-6


def test_bayesian_ridge_and_relevance_determination(spark):
    x, y, df = regression(spark, noise=0.2)
    names = ["x0", "x1", "x2"]
    configs = [linear.LinearConfig("bayesridge", cfg_id=0), linear.LinearConfig("ard", cfg_id=1)]
    models = {r["cfg_id"]: r for r in linear.fit(df, K, names, "y", configs).collect()}
    close(models[0]["coef"], [2, 0, -1], 0.1)
    assert 0.02 < models[0]["noise"] < 0.08
    assert abs(models[1]["coef"][1]) < 0.02
    scored = linear.predict(df, linear.fit(df, K, names, "y", configs[:1]), K, names, interval=2.0)
    inside = scored.filter("split = 'test'").select(F.avg(F.col("y").between(F.col("lower_conf"), F.col("upper_conf")).cast("double"))).first()[0]
    assert inside > 0.8


def test_product_sums_by_arrow_equal_those_by_aggregates(spark, monkeypatch):
    _, _, df = regression(spark)
    df = df.withColumn("x1", F.when(F.col("t") == 5, None).otherwise(F.col("x1")))
    a = gram.gram(df, K, ["x0", "x1", "y"]).first()["m"]
    monkeypatch.setattr(gram, "MAX_JVM_SUMS", 1)
    close(gram.gram(df, K, ["x0", "x1", "y"]).first()["m"], a)


def test_failed_configuration_is_recorded(spark):
    _, _, df = regression(spark)
    configs = [linear.LinearConfig("ridge", cfg_id=0), linear.LinearConfig("nonsense", cfg_id=1)]
    out = {r["cfg_id"]: r for r in experiment.run_linear(df, K, ["x0"], "y", 7, configs).collect()}
    assert out[0]["dataset"] == "a" and out[0]["status"] == "ok" and out[0]["RMSE_Test"] > 0
    assert out[1]["dataset"] == "Failure" and out[1]["RMSE_Test"] is None and out[1]["RMSE_Test_RW"] is None
    assert len([c for c in out[0].asDict() if c.split("_")[0] in ("RMSE", "MAPE", "sMAPE")]) == 24


def test_components_equal_a_decomposition_of_standardised_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (100, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 3 + 0.1 * base[:, 1], base[:, 1], np.ones(100)])
    df = split_at(many(spark, {f"x{i}": x[:, i] for i in range(4)}), 80)
    out = collected(pca.pca_transform(df, K, [f"x{i}" for i in range(4)]), "t")
    train = x[:80]
    sd = np.where(train.std(0) > 0, train.std(0), 1.0)
    z = (x - train.mean(0)) / sd
    u, s, v = np.linalg.svd(z[:80], full_matrices=False)
    count = int(out["n_components"][0])
    assert count == int(np.searchsorted(np.cumsum(s ** 2 / (s ** 2).sum()), 0.95, side="right")) + 1
    for i in range(count):
        want = z @ v[i]
        close(np.abs(out[f"PC{i}"]), np.abs(want), 1e-6)
    assert out[f"PC{count}"].isna().all()


def test_components_need_complete_train_rows(spark):
    df = split_at(many(spark, {"a": [1, None, 3, 4], "b": [4, 2, 3, 1]}), 3)
    out = collected(pca.pca_transform(df, K, ["a", "b"]), "t")
    assert out["PC0"].isna().all()


def seasonal(n=160, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 50 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.5, n)


def rmse(a, b):
    return float(np.sqrt(np.mean((np.asarray(a) - np.asarray(b)) ** 2)))


@pytest.mark.parametrize("cfg", [
    smoothing.SmoothingConfig("add", False, "add", 7),
    smoothing.SmoothingConfig("add", True, "add", 7, remove_bias=True),
    smoothing.SmoothingConfig("add", False, "mul", 7),
    smoothing.SmoothingConfig("add", False, "add", 7, transf="log"),
    smoothing.SmoothingConfig("add", False, "add", 7, transf="pw"),
])
def test_smoothing_beats_the_seasonal_random_walk(spark, cfg):
    y = seasonal()
    out = collected(smoothing.smoothing_forecast(split_at(many(spark, {"y": y}), 130), K, "y", cfg), "t")
    naive = rmse(y[130:], y[123:-7])
    assert rmse(y[130:], out["prediction"][130:]) < naive


def test_smoothing_is_handed_on_between_stretches(spark):
    y = seasonal(90)
    y[20] = np.nan
    df = split_at(many(spark, {"y": y}), 70)
    cfg = smoothing.SmoothingConfig("add", False, "add", 7, remove_bias=True)
    whole = collected(smoothing.smoothing_forecast(df, K, "y", cfg), "t")
    parts = collected(smoothing.smoothing_forecast(df, K, "y", cfg, size=32), "t")
    close(whole["prediction"], parts["prediction"])


def test_simple_smoothing_by_hand(spark):
    out = collected(smoothing.smoothing_forecast(
        split_at(many(spark, {"y": [10, 20, None, 30, 40]}), 4), K, "y", smoothing.SmoothingConfig(),
        np.array([0.5, 0, 0, 1.0])), "t")
    close(out["prediction"], [10, 10, 15, 15, 22.5])
    fixed = collected(smoothing.smoothing_forecast(
        split_at(many(spark, {"y": [10, 20, 30, 40, 50]}), 3), K, "y", smoothing.SmoothingConfig(),
        np.array([0.5, 0, 0, 1.0]), one_step=False), "t")
    close(fixed["prediction"][3:], [22.5, 22.5])


def test_multiplicative_season_with_zeros(spark):
    y = np.abs(np.round(seasonal(60) - 60))
    y[3] = 0.0
    out = collected(smoothing.smoothing_forecast(
        split_at(many(spark, {"y": y}), 50), K, "y", smoothing.SmoothingConfig(None, False, "mul", 7)), "t")
    assert np.isfinite(out["prediction"]).all()


def test_autoregression_recovers_its_coefficients(spark):
    rng = np.random.default_rng(3)
    y = np.zeros(600)
    for i in range(2, 600):
        y[i] = 1.0 + 0.5 * y[i - 1] - 0.3 * y[i - 2] + rng.normal(0, 0.1)
    df = split_at(many(spark, {"y": y}), 500)
    out = collected(arima.arima_forecast(df, K, "y", arima.ArimaConfig(p=2)), "t")
    assert abs(rmse(y[500:], out["prediction"][500:]) - 0.1) < 0.02
    inside = ((out["lower_conf"] <= out["y"]) & (out["y"] <= out["upper_conf"]))[500:].mean()
    assert 0.88 < inside <= 1.0


@pytest.mark.parametrize("cfg", [
    arima.ArimaConfig(p=1, d=1), arima.ArimaConfig(p=1, q=1, seasonal_p=1, seasonal_d=1, season=7),
    arima.ArimaConfig(p=1, seasonal_d=1, season=7, transf="log")])
def test_seasonal_autoregression(spark, cfg):
    y = seasonal(200)
    df = split_at(many(spark, {"y": y, "e": np.arange(200) % 7 == 0}), 160)
    one = collected(arima.arima_forecast(df, K, "y", cfg, ["e"]), "t")
    far = collected(arima.arima_forecast(df, K, "y", cfg, ["e"], one_step=False), "t")
    parts = collected(arima.arima_forecast(df, K, "y", cfg, ["e"], one_step=False, size=50), "t")
    assert rmse(y[160:], one["prediction"][160:]) < rmse(y[160:], y[159:-1])
    # the first forecast after train is the same, and so is the recursion in stretches
    close(one["prediction"][160:161], far["prediction"][160:161], 1e-6)
    close(far["prediction"][160:], parts["prediction"][160:])
    assert np.isfinite(far["prediction"][160:]).all()


def test_gaussian_process_with_all_rows_inducing_is_exact(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 10, 40))
    y = np.sin(x) + rng.normal(0, 0.1, 40)
    df = split_at(many(spark, {"x": x, "y": y}), 30)
    cfg = gp.GpConfig("se + rq", noise=0.05, length=1.5, constant_mean=False)
    out = collected(gp.gp_forecast(df, K, ["x"], "y", [cfg], inducing=30, standardize_x=False, standardize_y=False), "t")
    a, b = x[:30, None], x[:, None]
    k = gp.kernel(cfg, a, a) + 0.05 * np.eye(30)
    cross = gp.kernel(cfg, b, a)
    close(out["prediction"], cross @ np.linalg.solve(k, y[:30]), 1e-3)
    var = gp.kernel_diagonal(cfg, b) - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)) + 0.05
    close(out["variance"], var, 1e-3)


def test_gaussian_process_picks_the_likelier_kernel(spark):
    t = np.arange(120.0)
    y = 5 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(0, 0.1, 120)
    df = split_at(many(spark, {"x": t, "y": y}), 100)
    kernels = [gp.GpConfig("se", noise=0.05), gp.GpConfig("periodic(se)", noise=0.05, period=7.0)]
    out = collected(gp.gp_forecast(df, K, ["x"], "y", kernels, standardize_x=False), "t")
    assert set(out["kernel"]) == {"periodic(se)"}
    assert rmse(y[100:], out["prediction"][100:]) < 1.0


def test_gaussian_process_leaves_out_rows_and_series_it_cannot_use(spark):
    """Rows with a missing feature and series without a complete train row get no forecast; the others keep theirs."""
    t = np.arange(60.0)
    whole = split_at(many(spark, {"x": t, "y": np.sin(t)}), 50)
    holes = split_at(many(spark, {"x": np.where(t % 10 == 3, np.nan, t), "y": np.sin(t)}, "b"), 50)
    bare = split_at(many(spark, {"x": np.where(t < 50, np.nan, t), "y": np.sin(t)}, "c"), 50)
    out = collected(gp.gp_forecast(whole.unionByName(holes).unionByName(bare), K, ["x"], "y", [gp.GpConfig("se", noise=0.05)]), "t")
    missing = out["prediction"].isna().groupby(out["series_id"]).sum()
    assert missing.to_dict() == {"a": 0, "b": 6, "c": 60}


def test_trees_and_their_importance(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (200, 2))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + 0.01 * x[:, 1]
    df = split_at(many(spark, {"a": x[:, 0], "b": x[:, 1], "y": y}), 150)
    model = trees.fit_trees(df, K, ["a", "b"], "y", trees.TreeConfig(n_estimators=3))
    out = collected(trees.predict_trees(df, model, K, ["a", "b"], "y"), "t")
    assert rmse(out["y"][150:], out["prediction"][150:]) < 2.5
    table = trees.feature_importance(spark, model, ["a", "b"]).collect()
    assert table[0]["feature"] == "a" and abs(sum(r["importance"] for r in table) - 1) < 1e-6


def test_cross_validation_columns_and_short_series(spark):
    _, _, df = regression(spark)
    out = experiment.cross_validate(df, K, ["x0", "x2"], "y", linear.LinearConfig(alpha=0.1)).first()
    assert out["ts_cv_rmse_mean"] < 1.0 and out["ts_cv_rmse_2"] is not None
    short = df.filter("t < 60")
    assert experiment.cross_validate(short, K, ["x0"], "y", linear.LinearConfig()).count() == 0
    shuffled = experiment.cross_validate(df, K, ["x0", "x2"], "y", linear.LinearConfig(alpha=0.1), shuffled=True).first()
    assert shuffled["shuf_cv_rmse_4"] is not None
    assert pd.notna(shuffled["shuf_cv_rmse_std"])


def test_one_singular_series_leaves_the_others_alone(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in ("bad", "good", "fine"):
        for t in range(40):
            a, b = rng.normal(), rng.normal()
            rows.append((key, t, "train" if t < 30 else "test", a, a if key == "bad" else b, 2 * a - b + 0.01 * rng.normal()))
    frame = spark.createDataFrame(rows, "series_id string, t long, split string, a double, b double, y double").coalesce(1)
    configs = [linear.LinearConfig("ridge", alpha=0.0)]
    seen = []
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        status = {r.series_id: r.status for r in linear.fit(frame, ["series_id"], ["a", "b"], "y", configs).collect()}
        assert status["good"] == status["fine"] == "ok" and status["bad"].startswith("failed")
        rolled = linear.rolling_origin(frame, ["series_id"], ["a", "b"], "y", configs).toPandas()
        assert rolled.groupby("series_id").prediction.count().to_dict() == {"bad": 0, "fine": 10, "good": 10}
        seen.append(rolled.sort_values(["series_id", "t"]).prediction.to_numpy())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(*seen, equal_nan=True)


def test_large_values_keep_their_slope(spark, monkeypatch):
    """Slope 3 on values near 1e9 with a spread of 1: for a fit, refits on all earlier rows (both ways) and components."""
    rng = np.random.default_rng(8)
    x = 1e9 + rng.random(240)
    z = x - 1e9
    df = split_at(many(spark, {"x": x, "x2": -2 * z + 1e9, "y": 3 * z}), 120)
    model = linear.fit(df, K, ["x"], "y", [linear.LinearConfig(alpha=0.0)]).first()
    assert abs(model["coef"][0] - 3) < 1e-6
    args = (df, K, ["x"], "y", [linear.LinearConfig(alpha=0.0)])
    for limit in (gram.MAX_JVM_SUMS, 1):
        monkeypatch.setattr(gram, "MAX_JVM_SUMS", limit)
        monkeypatch.setattr(linear, "MAX_JVM_SUMS", limit)
        monkeypatch.setattr(gram, "CHUNK_ROWS", 32)
        monkeypatch.setattr(linear, "CHUNK_ROWS", 32)
        out = collected(linear.rolling_origin(*args), "t")
        close(out["prediction"], 3 * z[120:], 1e-5)
        fitted = pca.fit_pca(df, K, ["x", "x2"]).first()
        assert fitted["n_components"] == 1 and abs(fitted["explained"][0] - 1) < 1e-6


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 3)) + [1e6, 0, -5]
    whole = gram.of_rows(x)
    parts = np.stack([gram.of_rows(x[a:b]) for a, b in ((0, 10), (10, 10), (10, 11), (11, 90))])
    close(gram.merge(parts), whole, 1e-9)
    first = gram.unpack([gram.of_rows(x[:30])], 4)[0]
    before, last = gram.added(first, x[30:])
    close(last[np.triu_indices(4)], whole, 1e-9)
    close(before[5][np.triu_indices(4)], gram.of_rows(x[:35]), 1e-9)


@pytest.mark.parametrize("cfg", [
    smoothing.SmoothingConfig(), smoothing.SmoothingConfig("add", True, None), smoothing.SmoothingConfig("add", False, "add", 7, remove_bias=True)])
def test_chunks_of_a_smoother_start_where_a_walk_would(spark, cfg):
    """Maps composed chunk by chunk against one walk over all rows, with gaps, test rows masked or not."""
    rng = np.random.default_rng(10)
    y = 20 + 0.05 * np.arange(150) + 4 * np.sin(np.arange(150) * 2 * np.pi / 7) + rng.normal(size=150)
    y[[3, 40, 41, 90, 130]] = np.nan
    df = split_at(many(spark, {"y": y}), 120)
    weights = np.array([[0.3, 0.1, 0.2, 0.95], [0.5, 0.02, 0.1, 0.9]])
    if not (cfg.trend and cfg.damped):
        weights[:, 3] = 1.0
    for one_step in (True, False):
        out = collected(smoothing.smoothing_forecast(df, K, "y", cfg, weights, one_step, size=16), "t")
        first = smoothing.first_states(y[:2 * max(cfg.season, 1)], cfg, weights)
        _, after = smoothing.walk(y[:120], np.arange(120), first, cfg.seasonal, max(cfg.season, 1))
        best = int(after[:, 6].argmin())
        begin = smoothing.first_states(y[:2 * max(cfg.season, 1)], cfg, weights[best:best + 1])
        if cfg.remove_bias:
            begin[:, 5] = after[best, 7] / after[best, 8]
        shown = np.where((np.arange(150) < 120) | one_step, y, np.nan)
        want, _ = smoothing.walk(shown, np.arange(150), begin, cfg.seasonal, max(cfg.season, 1))
        close(out["prediction"], want, 1e-9)


def test_weights_are_refined(spark):
    """A series that simple smoothing with weight 0.83 made: the search comes near it, far from the grid."""
    rng = np.random.default_rng(11)
    level, y = 50.0, []
    for e in rng.normal(size=400):
        y.append(level + e)
        level += 0.83 * e
    df = split_at(many(spark, {"y": y}), 399)
    out = collected(smoothing.smoothing_forecast(df, K, "y", smoothing.SmoothingConfig()), "t")
    error = lambda a: np.mean((np.array(y[:399]) - smoothing.walk(np.array(y[:399]), np.arange(399), smoothing.first_states(
        np.array(y[:2]), smoothing.SmoothingConfig(), np.array([[a, 0, 0, 1.0]])), None, 1)[0]) ** 2)
    best = min(error(a) for a in np.linspace(0.5, 0.99, 200))
    got = np.mean((np.array(y[:399]) - out["prediction"][:399]) ** 2)
    assert got < best * 1.002 < error(0.7)
