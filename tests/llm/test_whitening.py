import math

import numpy as np
import pytest

from sparkcast.llm import whitening


def brute(rows, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    far = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    c = ((n * x - s) / n).astype(float)
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return [i for i, _ in good], far, c @ w / np.sqrt(e), e / np.trace(v)


def flat(frame, k):
    rows = frame.orderBy("vec_id", "component").collect()
    ids = [r.vec_id for r in rows][::k]
    return ids, [r.deviation for r in rows][::k], np.array([r.whitened for r in rows], float).reshape(-1, k), rows


def compare(spark, rows, k, schema="array<float>", tol=1e-6):
    frame = spark.createDataFrame([(i, v, 0, "n") for i, v in rows], f"vec_id long, embedding {schema}, n int, component string").repartition(5)
    k = min(k, max(len(v) for _, v in rows if v))
    ids, far, white, out = flat(whitening.whiten(frame, k), k)
    want_ids, want_far, want, explained = brute(sorted((r for r in frame.select("vec_id", "embedding").collect()), key=lambda r: r[0]), k)
    assert ids == want_ids and far == want_far
    assert [int(r.deviation_wide) for r in out][::k] == want_far
    for j in range(k):
        assert min(np.abs(white[:, j] - want[:, j]).max(), np.abs(white[:, j] + want[:, j]).max()) < tol
        assert out[j].component == j + 1 and out[j].n == len(want_ids)
        assert abs(out[j].explained / explained[j] - 1) < 1e-6
    assert out[0].identity_error < 1e-9
    return out


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) * np.logspace(0, -2, 20)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mixed)]
    rows += [(1000, None), (1001, []), (1002, [None] * 20), (1003, [float("nan")] + [0.0] * 19), (1004, [math.inf] * 20), (2000, rows[7][1])]
    compare(spark, rows, 8)


def test_few_dimensions(spark):
    rng = np.random.default_rng(4)
    compare(spark, [(i, [float(a), float(a + b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], 8, "array<double>")


def test_nearly_dependent_columns(spark):
    """A condition of 1e8 in the components asked for: the square of it is beyond what one Gram matrix holds."""
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(300, 3)) * 1e9)
    v = np.column_stack([base[:, 0], base[:, 0] + rng.integers(0, 9, 300), base[:, 2]]) / 1024
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(frame, 3).collect()
    assert out[0].identity_error < 1e-6
    fitted = whitening.fit(frame.select("embedding"), 3)
    x = np.floor(1024 * v).astype(np.int64)
    c = x - x.mean(axis=0)
    assert np.allclose(fitted.deviations, np.linalg.svd(c)[1] / np.sqrt(len(c)), rtol=1e-6)
    assert any(r.deviation is None and r.deviation_wide > 1 << 63 for r in out)


def test_no_variance(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0, float(i % 3), 2.0 * (i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    out = whitening.whiten(frame, 8).collect()
    assert {r.component for r in out if r.whitened is None} == {2, 3, 4} and len(out) == 120
    assert out[0].identity_error < 1e-6
    same = whitening.whiten(frame.where("vec_id = 3"), 8).collect()
    assert [r.whitened for r in same] == [None] * 4 and same[0].deviation == 0 and same[0].explained == 0


def test_empty_and_ragged(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [None])], "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == []
    assert whitening.whiten(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
