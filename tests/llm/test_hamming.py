import random

from pyspark.sql import functions as F

from sparkcast.llm import hamming


def brute(rows, queries, k):
    out = []
    for q, c in set(queries):
        near = sorted((((c ^ x) & (1 << 64) - 1).bit_count(), i) for i, x in set(rows))[:k]
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_against_brute_force(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    rows = [(i, signed(rng.getrandbits(64))) for i in range(150)]
    for i in range(150, 260):
        c = centre
        for b in rng.sample(range(64), rng.randrange(0, 9)):
            c ^= 1 << b
        rows.append((i, signed(c)))
    rows += [(300 + i, signed(centre)) for i in range(40)] + [rows[3], rows[3]]
    frame = spark.createDataFrame([(i, c, 1, "x") for i, c in rows] + [(None, 5, 1, ""), (999, None, 1, "")], "vec_id long, code long, id int, query string")
    queries = [r for r in rows if r[0] % 20 == 0]
    got = hamming.nearest(frame, frame.where("vec_id % 20 = 0"), k=7).collect()
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got) == brute(rows, queries, 7)


def test_rows_that_spark_makes_stay_few(spark, monkeypatch):
    """Several shards and blocks give the same, and no round hands on more than some rows for each query."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    rows = [(i, signed(rng.getrandbits(64) if i % 4 else centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, code long")
    for name, value in (("SHARD", 60), ("BLOCK", 16), ("LEAST", 8), ("HELD", 500)):
        monkeypatch.setattr(hamming, name, value)
    made, best = [], hamming._best
    monkeypatch.setattr(hamming, "_best", lambda found, k: made.append(found.count()) or best(found, k))
    got = hamming.nearest(frame, frame.where("vec_id % 20 = 0"), k=3).collect()
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got) == brute(rows, [r for r in rows if r[0] % 20 == 0], 3)
    assert len(made) == 3 and max(made) <= 3 * 45 * 8


def test_small_and_empty(spark):
    rows = [(0, 0), (1, 3), (2, 255)]
    frame = spark.createDataFrame(rows, "vec_id long, code long")
    got = hamming.nearest(frame, frame.where("vec_id = 0"), k=10).collect()
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got) == [(0, 0, 0, 1), (0, 1, 2, 2), (0, 2, 8, 3)]
    assert hamming.nearest(frame.limit(0), frame, k=3).collect() == []
    assert hamming.nearest(frame, frame.limit(0), k=3).collect() == []


def test_sign_code(spark):
    row = spark.createDataFrame([([0.5, -1.0, None, float("nan"), 2.0],), (None,), ([],)], "e array<double>")
    assert [r.c for r in row.select(hamming.sign_code(F.col("e")).alias("c")).collect()] == [0b10001, None, 0]
