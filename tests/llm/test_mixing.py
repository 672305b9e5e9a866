import random

import numpy as np
from pyspark.sql import functions as F

from sparkcast.llm import mixing

TELLING = {"law": ["court", "judge", "statute"], "food": ["oven", "salt", "dough"], "sea": ["harbour", "tide", "###"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d = rng.choices(list(TELLING), [6, 3, 1])[0]
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(TELLING[d])
        rows.append((i, " ".join(words), d))
    return rows


def test_totals_and_brute_force(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, tokens int, posterior string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows[:400]] + [(None, "law"), (3, None), (4, "other")], "doc_id long, domain string")
    weights = {"law": 0.3, "food": 0.3, "sea": 0.4}
    got = mixing.mix(docs, labelled, weights).toPandas()
    truth = {i: d for i, _, d in rows}
    p = np.array(got._posterior.tolist())
    assert np.allclose(p.sum(1), 1)
    assert np.mean([list(weights)[k] == truth[i] for k, i in zip(p.argmax(1), got.doc_id) if i >= 400]) > 0.97
    t, w = got._tokens.to_numpy(float), got._rate.to_numpy()
    assert (t == [sum(w != '###' for w in x.split()) for x in got.text]).all()
    assert np.allclose((t * w) @ p, np.array([0.3, 0.3, 0.4]) * t.sum(), rtol=2e-3) and (w >= 0).all()
    assert abs((t * got._copies).sum() / t.sum() - 1) < 0.1 and (np.abs(got._copies - w) < 1).all()


def plain_steps(t, p, target, most, rounds=20_000):
    """Projected gradient in numpy, to the end."""
    size, w = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1], np.ones(len(t))
    for _ in range(rounds):
        w = np.clip(w - size * p @ ((t * w) @ p - target), 0, most)
    return w


def test_bounds_and_infeasible_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    t = rng.integers(0, 90, 300).astype(float)
    members = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(t, p)], "tokens double, posterior array<double>").coalesce(1)
    have = t @ p
    for weights, anchor, most in (([0.6, 0.3, 0.1], 0, 1.0), ([1.0, 0.0, 0.0], None, 2.0)):
        fitted = mixing.match(members, weights, anchor=anchor, most=most)
        total = have.sum() if anchor is None else have[anchor] / weights[anchor]
        target = np.array(weights) * total
        got = members.select(fitted.rate(F.col("posterior")).alias("w")).toPandas().w.to_numpy()
        loss = lambda w: (off := (t * w) @ p - target) @ off
        start, end = loss(np.ones(300)), loss(plain_steps(t, p, target, most))
        assert loss(got) <= end + 1e-3 * start
        assert np.allclose((t * got) @ p, fitted.expected) and (got >= 0).all() and (got <= most).all()


def test_rare_domains_meet_their_targets(spark):
    """Totals of a domain with 0.05 % of the tokens were 3.4 % of all instead of 5 % when the steps ended."""
    rows = [(1000.0, [1.0, 0.0, 0.0])] * 1799 + [(1000.0, [0.0, 1.0, 0.0])] * 200 + [(1000.0, [0.0, 0.0, 1.0])]
    members = spark.createDataFrame(rows, "tokens double, posterior array<double>").coalesce(1)
    fitted = mixing.match(members, [0.85, 0.10, 0.05])
    assert fitted.converged and fitted.met and np.allclose(fitted.expected, fitted.targets, rtol=1e-4)
    bounded = mixing.match(members, [0.85, 0.10, 0.05], most=4.0)
    assert bounded.converged and not bounded.met and abs(bounded.expected[2] - 4000) < 1


def test_odd_rows(spark):
    rows = corpus(120, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (5, ""), (6, rows[0][1]), (6, rows[0][1]), (7, "court " * 200_000)],
                                 "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"law": 0.6, "food": 0.3, "sea": 0.1})
    assert got.count() == 125 and got.where("_rate IS NULL OR _copies < 0").count() == 0
    assert mixing.mix(docs, labelled.limit(0), {"law": 1.0, "sea": 1.0}).where("_rate = 1").count() == 125
    assert mixing.mix(docs.limit(0), labelled, {"law": 1.0, "sea": 1.0}).collect() == []
    plain = mixing.rates(docs, labelled, {"law": 0.6, "food": 0.3, "sea": 0.1})[0]
    assert sorted(r[0] for r in plain.select("_copies").collect()) == sorted(r[0] for r in got.select("_copies").collect())
    assert "Python" not in got._jdf.queryExecution().toString()


def test_nearly_pure_documents_at_the_bound(spark):
    """Explicit steps crept along the bounds and were not settled after 200; the end is now reached in few passes."""
    x = np.random.default_rng(5).uniform(-30, 4, 20_000)
    raw = 1 / (1 + np.exp(-x))
    members = spark.createDataFrame([(100.0, [float(1 - r), float(r)]) for r in raw], "tokens double, posterior array<double>").coalesce(1)
    fitted = mixing.match(members, [0.99, 0.01], anchor=0, most=1.0)
    assert fitted.converged and len(fitted.steps) < 20
    targets = np.array(fitted.targets)
    # without a bound on the steps the nearest rates are 1 on one side of a line and 0 on the other, up to one document
    order = np.argsort(raw)
    sums = np.cumsum(100.0 * np.stack([1 - raw, raw], axis=1)[order], axis=0)
    nearest = np.linalg.norm(sums - targets, axis=1).min()
    assert np.linalg.norm(np.array(fitted.expected) - targets) <= max(nearest * 1.01, 1e-4 * targets.min())
