import random

import xxhash

from sparkcast.llm import simhash
from sparkcast.llm.components import components


def plain_fingerprint(text, n=3):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(least.get(g, d), d)
    return {d: (f - (1 << 64) if f >> 63 else f, least[g]) for (d, _), f, g in zip(rows, fps, group)}


def corpus():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    texts = [None, "", " \n\t", "One", "one", "Two words", base, base.upper(), base + " end", "É é Ünïcode " + base[:90], "a b c", "ab c d"]
    for i in range(60):
        words = base.split()
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts.append(" ".join(f"long{i % 7919}" for i in range(300_000)))
    return [(7 + 3 * i, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == plain_components(rows)


def test_tiles_find_every_close_pair(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(300)}
    for p in list(points):
        for _ in range(2):
            q = p
            for k in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << k
            points.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius, segments, salts in ((3, 4, 1), (6, 1, 3)):
        want = {frozenset((p, q)) for p in points for q in points if p < q and (p ^ q).bit_count() <= radius}
        got, met = set(), 0
        for r in simhash.tile_pairs(frame, radius, segments, salts, tile=16).collect():
            met += len(r.fps) * len(r.others)
            for x in r.fps:
                for y in r.others:
                    x64, y64 = x % (1 << 64), y % (1 << 64)
                    if x != y and (x64 ^ y64).bit_count() <= radius:
                        got.add(frozenset((x64, y64)))
        assert got == want
        assert met < len(points) ** 2 * (0.2 if segments == 4 else 1)


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "same words here"), (4, "same words here"), (None, "other"), (4, "same words here")],
                                "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(odd).collect() if r.component_id)
    assert got == [(-1, 4), (4, 4), (4, 4)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1500)]
    links += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    want = {x: top(x) for x in root if top(x) != x}
    frame = spark.createDataFrame(links, "x long, y long").repartition(5)
    assert {r.node: r.component for r in components(frame).collect()} == want


def test_first_of_similar(spark):
    rng = random.Random(8)
    rows, want = [(900, None, "x"), (901, "", "x"), (902, " \n", "x")], {900}
    for g in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        want.add(10 * g)
        for j in range(rng.choice([1, 3, 5])):
            copy = list(words)
            for _ in range(min(j, 3)):
                copy[rng.randrange(300)] = "other"
            rows.append((10 * g + j, " ".join(copy), "x"))
    rows += [(0, rows[3][1], "x"), (950, rows[3][1].upper(), "x"), (None, rows[3][1], "x"), (903, "a text of its own", "x"), (904, "a b", "x"), (905, "A b", "x")]
    want |= {903, 904}
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string").repartition(4)
    got = simhash.first_of_similar(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert simhash.first_of_similar(docs.limit(0)).collect() == []


def test_chain_keeps_what_is_not_similar(spark):
    words = [f"v{i}" for i in range(400)]
    docs = [(i, " ".join(words[12 * i:12 * i + 150])) for i in range(12)]
    kept = {r.doc_id for r in simhash.first_of_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        if i not in kept:
            assert any(j in kept and simhash.similarity(t, u) >= 0.8 for j, u in docs)


def test_many_texts_of_one_component_stay_in_few_rounds(spark, monkeypatch):
    """Candidates that are all linked and mostly not similar are judged as one by one, but not in a round for each."""
    rng = random.Random(5)
    docs = []
    for i in range(240):
        words = docs[rng.randrange(len(docs))][1].split() if i % 3 == 2 else [f"x{rng.randrange(10 ** 6)}" for _ in range(60)]
        words[rng.randrange(60)] = "other"
        docs.append((i, " ".join(words)))
    want = []
    for i, t in docs:
        if not any(simhash.similarity(t, u) >= 0.8 for _, u in want):
            want.append((i, t))
    assert 150 < len(want) < 240
    rounds, judge = [], simhash._judge
    monkeypatch.setattr(simhash, "JUDGED", 50)
    monkeypatch.setattr(simhash, "_judge", lambda *args: rounds.append(1) or judge(*args))
    monkeypatch.setattr(simhash, "wide_links", lambda points, similar: points.crossJoin(points.selectExpr("min(w) AS b")).selectExpr("w AS a", "b"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.first_of_similar(frame).collect()) == [i for i, _ in want]
    assert len(rounds) <= 4


def test_first_of_similar_keeps_columns_of_its_own_names(spark):
    text = "a b c d e f g h"
    frame = spark.createDataFrame([(1, text, "x", "y"), (2, text, "z", "u")], "doc_id long, text string, _w string, _place string")
    assert [tuple(r) for r in simhash.first_of_similar(frame).collect()] == [(1, text, "x", "y")]


def test_short_and_long_near_copies_are_candidates():
    rng = random.Random(4)
    for size, own in ((4, 1), (8, 2), (16, 4), (40, 10), (80, 20), (160, 40)):
        found = 0
        for trial in range(200):
            words = [f"{trial} {rng.random()}" .replace(" ", "_") for _ in range(size + own + 4)]
            a, b = " ".join(words[:size + 4]), " ".join(words)
            assert simhash.similarity(a, b) == 0.8
            (n, *x), (m, *y) = simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)
            assert (n, m) == (size, size + own)
            apart = [((p ^ q) % (1 << 64)).bit_count() for p, q in zip(x, y)]
            found += apart[0] <= simhash.FIRST and sum(apart) <= simhash.ALL
        assert found >= 0.97 * 200, (size, found)


def test_wide_tiles_link_every_candidate(spark):
    rng = random.Random(6)
    points = []
    for n in (0, 1, 3, 9, 40, 44, 50, 55, 62, 400):
        for _ in range(12):
            base = [rng.getrandbits(64) for _ in range(4)]
            for j in range(3):
                words = [f if not j else f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in base]
                points.append((len(points) + 1, max(0, n + (rng.randrange(-3, 4) if n > 8 else 0)), *[f - (1 << 64) if f >> 63 else f for f in words]))
            points.append((len(points) + 1, int(n * 1.2), *points[-1][2:]))
    want = {}

    def top(i):
        while want.setdefault(i, i) != i:
            i = want[i]
        return i

    for i, n, *x in points:
        for j, m, *y in points:
            apart = [((p ^ q) % (1 << 64)).bit_count() for p, q in zip(x, y)]
            close = apart[0] <= simhash.FIRST and sum(apart) <= simhash.ALL and 0.8 * max(n, m) <= min(n, m) + 1e-6
            if close and (n + m >= 9 or not sum(apart)):
                low, high = sorted((top(i), top(j)))
                want[high] = low
    frame = spark.createDataFrame(points, "w long, n long, f0 long, f1 long, f2 long, f3 long").repartition(4)
    for texts in (1 << 14, 8):
        got = {r.node: r.component for r in components(simhash.wide_links(frame, texts=texts)).collect()}
        assert got == {i: top(i) for i in want if top(i) != i}
    assert simhash.wide_links(frame.limit(0)).collect() == []


def test_short_near_copies_go(spark):
    words = [f"q{i}" for i in range(12)]
    docs = [(1, " ".join(words[:8])), (2, " ".join(words[:9])), (3, " ".join(words[:12])), (4, "q1 q2"), (5, "Q1  q2"), (6, "q1 q3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_similar(frame).collect()) == [1, 3, 4, 6]
