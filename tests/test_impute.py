import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import close, collected, many, split_at
from sparkcast.operators import impute
from sparkcast.operators.quantiles import exact_quantiles

K = ["series_id"]


def gappy(n, p, seed, share=0.25, digits=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(10, 4, (n, p)), digits)
    x[rng.random((n, p)) < share] = np.nan
    return x


def neighbours(x, train, k):
    """Plain k nearest neighbours over all pairs, ties by position."""
    out = x.copy()
    p = x.shape[1]
    for i in range(len(x)):
        for c in range(p):
            if not np.isnan(x[i, c]):
                continue
            found = []
            for j in range(train):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if np.isnan(x[j, c]) or not both.any():
                    continue
                d = ((x[i] - x[j])[both] ** 2).sum() * p / both.sum()
                found.append((d, j, x[j, c]))
            found.sort()
            out[i, c] = np.mean([v for _, _, v in found[:k]]) if found else np.nanmean(x[:train, c])
    return out


@pytest.mark.parametrize("p, k, digits", [(2, 3, 1), (3, 4, 0), (4, 10, 2)])
def test_nearest_neighbours_equal_brute_force(spark, p, k, digits):
    x = gappy(150, p, p, digits=digits)
    x[100:120] = x[0]  # many equal rows
    names = [f"c{i}" for i in range(p)]
    df = split_at(many(spark, dict(zip(names, x.T))), 120)
    out = collected(impute.impute(df, K, names, "knn", k=k))
    close(out[names].to_numpy().ravel(), neighbours(x, 120, k).ravel())


def test_nearest_neighbours_of_a_cluster_next_to_an_outlier(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(0, 1e-6, 200), rng.normal(0, 1, 200)])
    x[0, 0] = 1e9
    x[150:, 1] = np.nan
    x[3, 0] = np.nan
    df = split_at(many(spark, {"a": x[:, 0], "b": x[:, 1]}), 150)
    df = df.withColumn("b", F.when(F.col("t") == 10, None).otherwise(F.col("b")))
    x[10, 1] = np.nan
    out = collected(impute.impute(df, K, ["a", "b"], "knn", k=5))
    close(out[["a", "b"]].to_numpy().ravel(), neighbours(x, 150, 5).ravel())


def test_mean_and_median_learn_from_train_only(spark):
    df = split_at(many(spark, {"y": [1, None, 3, 8, None, 100], "z": [1, 2, 3, 4, None, 6]}), 4)
    out = collected(impute.impute(df, K, ["y", "z"], "mean"))
    close(out["y"], [1, 4, 3, 8, 4, 100])
    close(out["z"], [1, 2, 3, 4, None, 6])  # no gap in train: the test gap stays
    close(collected(impute.impute(df, K, ["y"], "median"))["y"], [1, 3, 3, 8, 3, 100])
    assert impute.impute(df, K, ["y"], None) is df


def test_a_column_without_any_train_value_stays_empty(spark):
    df = split_at(many(spark, {"y": [None, None, None, 1]}), 3)
    close(collected(impute.impute(df, K, ["y"], "mean"))["y"], [None, None, None, 1])


@pytest.mark.parametrize("sample", [False, True])
def test_chained_imputation(spark, sample):
    rng = np.random.default_rng(0)
    a = rng.uniform(10, 20, 300)
    b = 2 * a + 5 + rng.normal(0, 0.1, 300)
    truth = np.column_stack([a, b])
    x = truth.copy()
    x[::7, 0] = np.nan
    x[3::7, 1] = np.nan
    df = split_at(many(spark, {"a": x[:, 0], "b": x[:, 1]}), 250)
    out = collected(impute.impute(df, K, ["a", "b"], "iterative", rounds=3, sample=sample))
    got = out[["a", "b"]].to_numpy()
    known = ~np.isnan(x)
    assert (got[known] == x[known]).all()
    assert np.abs(got - truth).max() < (1.0 if sample else 0.5)
    again = collected(impute.impute(df.repartition(3), K, ["a", "b"], "iterative", rounds=3, sample=sample))
    close(again[["a", "b"]].to_numpy().ravel(), got.ravel(), 1e-6)


def test_chained_imputation_keeps_to_its_bounds(spark):
    x = np.linspace(-5, 5, 60)
    y = x.copy()
    y[::5] = np.nan
    x2 = x.copy()
    x2[2::9] = np.nan
    df = split_at(many(spark, {"a": x2, "b": y}), 50)
    out = collected(impute.impute(df, K, ["a", "b"], "iterative", rounds=2, min_value=0.0))
    assert (out["b"][::5] >= 0).all()


def test_exact_quantiles_with_heavy_ties_and_tails(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros(700), np.exp(rng.normal(0, 4, 800)), [np.nan]])
    df = many(spark, {"y": x, "z": np.append(rng.integers(0, 3, 1500).astype(float), 1.0)})
    out = {r["column"]: r for r in exact_quantiles(df, K, ["y", "z"], [0.0, 0.25, 0.5, 0.9, 1.0], slices=16).collect()}
    close(out["y"]["q"], np.quantile(x[:-1], [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert out["y"]["n"] == 1500 and out["z"]["n"] == 1501


def test_chained_imputation_settles(spark, monkeypatch):
    """Many columns driven by two: a hundred rounds at most end early, at values that another round hardly moves; blocks don't matter."""
    from sparkcast.operators import chained

    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 2))
    x = 50 + base @ rng.normal(size=(2, 12)) + 0.1 * rng.normal(size=(300, 12))
    holes = rng.random(x.shape) < 0.1
    shown = np.where(holes, np.nan, x)
    df = split_at(many(spark, {f"c{i}": shown[:, i] for i in range(12)}), 250)
    names = [f"c{i}" for i in range(12)]
    out = collected(impute.impute(df, K, names, "iterative"))[names].to_numpy()
    assert np.array_equal(out[~holes], x[~holes])
    assert np.abs(out - x)[holes].mean() < 0.25
    monkeypatch.setattr(chained, "BLOCK_ROWS", 40)
    dealt = collected(impute.impute(df.repartition(5), K, names, "iterative"))[names].to_numpy()
    assert np.allclose(out, dealt, atol=1e-6)
    drawn = [collected(impute.impute(d, K, names, "iterative", rounds=4, sample=True))[names].to_numpy() for d in (df, df.repartition(3))]
    assert np.allclose(*drawn, atol=1e-6) and np.abs(drawn[0] - x)[holes].mean() < 0.4 and not np.allclose(drawn[0], out)
