import random

import numpy as np

from sparkcast.llm import toxicity

BAD = ["vile", "scummy", "rotten", "grûn"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 12) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD).upper() + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([(d, t, 0, 0.5) for d, t, _ in rows], "doc_id long, text string, toxic int, severity double")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows if d < 700] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    held = [(got[d], t, x) for d, t, x in rows if d >= 700]
    assert all(r.toxic == bool(x) for r, _, x in held)
    count = {d: sum(w.strip("!,").lower() in BAD for w in t.split()) for d, t, _ in rows}
    by_grade = [[r.severity for r, _, x in held if x and lo <= count[r.doc_id] < hi] for lo, hi in ((1, 3), (3, 8), (8, 99))]
    assert np.mean(by_grade[0]) < np.mean(by_grade[1]) < np.mean(by_grade[2])
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _, x in rows if not x}


def test_odd_rows(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "vile rotten"), (1, "vile rotten"), (2, "w1 " * 200_000 + "vile " * 9)],
                                "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.toxic) for r in toxicity.grade(odd, model).collect()))
    assert got == [(0, False), (1, False), (1, True), (1, True), (2, True)]
    assert toxicity.grade(odd.limit(0), model).collect() == []
    for labels in ([], [(0, 1)], [(0, 0), (1, 0)]):
        empty = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert empty == toxicity.SeverityModel()
    assert {(r.severity, r.toxic) for r in toxicity.grade(docs, toxicity.SeverityModel()).collect()} == {(0.0, False)}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    n, k = 4000, 3
    x = rng.normal(size=(n, k))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    grades = (score > -1).astype(np.int64) + (score > 1) + (score > 2.5)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    w, cuts = toxicity.fit_ordinal(rows, cols, x.ravel(), grades, k, 4)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(cuts, [-1, 1, 2.5], atol=0.2)
