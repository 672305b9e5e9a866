import hashlib
import random

import numpy as np

from sparkcast.llm import bits, exact


def test_filter_against_a_set():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    filter_ = exact.CuckooFilter(1 << 11)
    assert filter_.insert(keys[:4000])
    assert filter_.contains(keys[:4000]).all()
    assert filter_.contains(keys[4000:]).mean() < 0.01
    filter_.delete(keys[:1500])
    assert filter_.contains(keys[1500:4000]).all()
    assert filter_.contains(keys[:1500]).mean() < 0.01
    assert (filter_.table != 0).sum() == 2500
    filter_.delete(keys[1500:4000])
    assert not filter_.table.any()


def test_filter_overflows():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)
    assert not exact.CuckooFilter(1 << 8).insert(keys)


def brute(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(low, []).append((i is not None, i or 0, at))
    out = []
    for low, members in groups.items():
        has, top, last = max(members)
        out += [(rows[at][0], top if has else None, len(members), at == last, hashlib.sha256(low.encode()).hexdigest()) for *_, at in members]
    return out


def flat(rows):
    """Rows equal in id and text are one another's twins: which of them is kept is not told."""
    return sorted(rows, key=repr)


def result(frame):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in exact.exact_duplicates(frame).collect()]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 64)
    monkeypatch.setattr(exact, "STEP", 16)
    rng = random.Random(1)
    texts = ["", None, "A b", "a B", "É", "é", " a b", "x" * 3_000_000, "X" * 3_000_000, "İ"]
    texts += ["w%d v" % rng.randrange(120) for _ in range(300)] + ["hot Text"] * 200 + [f"unique {i}" for i in range(400)]
    rows = [(rng.randrange(10_000) * 7 + 1, t) for t in texts]
    rows += [rows[20], rows[20], rows[2], (None, "a b"), (None, "only null"), (None, "only null"), (-5, "neg"), (None, "neg")]
    frame = spark.createDataFrame([(i, t, 1, b"x", "s") for i, t in rows], "doc_id long, text string, key int, sha binary, rid string")
    assert flat(result(frame.repartition(7))) == flat(brute(rows))


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert result(frame) == []


def test_index_takes_and_forgets(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 50)
    docs = lambda lo, hi: exact.digests(spark.createDataFrame([(i, f"text {i % 90}") for i in range(lo, hi)], "doc_id long, text string"))
    index = exact.insert(exact.empty_index(docs(0, 300)), docs(0, 100))
    index = exact.insert(index, docs(100, 300))
    got = {bytes(r.sha): (r.doc_id, r.n) for r in index.entries.collect()}
    want = {}
    for i in range(300):
        k = hashlib.sha256(f"text {i % 90}".encode()).digest()
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    assert got == want
    index = exact.delete(index, docs(0, 40))
    assert {bytes(r.sha) for r in index.entries.collect()} == set(want) - {hashlib.sha256(f"text {i}".encode()).digest() for i in range(40)}
    index = exact.insert(index, docs(30, 50))
    got = {bytes(r.sha): (r.doc_id, r.n) for r in index.entries.collect()}
    assert got[hashlib.sha256(b"text 30").digest()] == (30, 1) and got[hashlib.sha256(b"text 45").digest()] == (225, 4)
    assert len(got) == 60


def test_a_false_hit_is_told_by_its_digest(spark, monkeypatch):
    """Keys that are all equal: every hit is checked against the stored SHA-256."""
    import pyarrow as pa

    stored = exact.Shard(exact.Shard(pa.table({c: pa.array([], t) for c, t in (
        ("shard", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()),
        ("filter", pa.binary()))})).table(0))
    rows = pa.table({"key": pa.array([7] * 6), "sha": [b"a", b"b", b"a", b"c", b"b", b"a"], "doc_id": pa.array([1, 2, 3, 4, None, 0], pa.int64()),
                     "rid": pa.array(range(6)), "n": pa.array([1] * 6)})
    stored.insert(rows)
    assert sorted(zip(stored.shas, stored.ids, stored.sizes)) == [(b"a", 3, 3), (b"b", 2, 2), (b"c", 4, 1)]
    stored.delete(rows.slice(1, 1))
    stored.insert(rows.slice(1, 1))
    assert sorted((s, n) for k, s, n in zip(stored.keys, stored.shas, stored.sizes) if k is not None) == [(b"a", 3), (b"b", 1), (b"c", 1)]


def test_bits(spark):
    held = [x * 0x5851F42D4C957F2D % (1 << 64) - (1 << 63) for x in range(1, 3000)]
    table = bits.build(spark.createDataFrame([(h,) for h in held], "h long"), len(held))
    assert bits.held(table, np.array(held)).all()
    other = np.array([x * 0x5851F42D4C957F2D % (1 << 64) - (1 << 63) for x in range(5000, 9000)])
    assert bits.held(table, other).mean() < 0.1
