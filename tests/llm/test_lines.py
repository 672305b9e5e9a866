import random

import numpy as np
import pyarrow as pa

from sparkcast.llm import lines


def brute(rows, similar=0.8):
    """Removed line numbers per row index, by comparing all pairs of lines."""
    places = [(d is None, d or 0, i, n, lines.plain(s)) for i, (d, t) in enumerate(rows) for n, s in enumerate((t or "").split("\n"))]
    places = sorted(p for p in places if p[4])
    distinct = sorted({p[4] for p in places})
    root = {s: s for s in distinct}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if lines.jaccard(a, b) >= similar:
                root[top(a)] = top(b)
    first, gone = {}, {i: set() for i in range(len(rows))}
    for p in places:
        if first.setdefault(top(p[4]), p) is not p:
            gone[p[2]].add(p[3])
    return gone


def corpus():
    rng = random.Random(6)

    def line(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(2, 8))) for _ in range(n))

    common = [line(14) for _ in range(6)] + ["Of.", "x", "Read  more"]
    rows = [(0, None), (1, ""), (2, "\n \n"), (None, common[0] + "\nown line of nobody else")]
    for i in range(10, 70):
        body = [line(rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(common)
            if rng.random() < 0.6 and len(s) > 30:
                at = rng.randrange(len(s))
                s = s[:at] + rng.choice("xyz") + s[at:]
            body.insert(rng.randrange(len(body) + 1), rng.choice([s, s.upper(), "  " + s + " "]))
        rows.append((i, "\n".join(body)))
    rows += [(80, rows[20][1]), (81, rows[20][1])]
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, line string, k1 int").repartition(3)
    got = {r.doc_id: r for r in lines.without_duplicate_lines(docs).collect()}
    assert len(got) == len(rows)
    for i, gone in brute(rows).items():
        d, text = rows[i]
        assert set(got[d]._gone or []) == gone, (d, gone)
        want = None if text is None else "\n".join(s for n, s in enumerate(text.split("\n")) if n not in gone)
        assert got[d].text == want and got[d].line == "s"


def test_recall_of_bands():
    rng = random.Random(9)
    hit = total = 0
    for _ in range(400):
        a = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(30))
        b = list(a)
        for _ in range(rng.randrange(1, 5)):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b)
        assert lines.are_similar(a, b, 0.8) == (lines.jaccard(a, b) >= 0.8)
        if lines.jaccard(a, b) >= 0.8:
            total += 1
            x, y = lines.signatures([a, b])
            hit += bool((x[:-1] == y[:-1]).any()) and bin(int(x[-1] ^ y[-1])).count("1") <= lines.APART
    assert total > 200 and hit >= 0.96 * total


def test_pairs_at_once_are_judged_as_one_by_one(monkeypatch):
    rng = random.Random(3)
    pairs = [("ab", "ab"), ("ab", "ac"), ("ab", "ab\0\0\0"), ("abcd", "abcde"), ("aaaaaaaa", "aaaaaa"), ("x" * 3000, "x" * 2000 + "y")]
    for _ in range(1500):
        a = "".join(rng.choice("abcdé \U0001f600") for _ in range(rng.randrange(1, 120)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        pairs.append((a, "".join(b)))
    want = [lines.are_similar(a, b, 0.8) for a, b in pairs]
    assert 300 < sum(want) < 1200
    judged, judge = [], lines.are_similar
    monkeypatch.setattr(lines, "are_similar", lambda *args: judged.append(args) or judge(*args))
    assert lines._alike(*map(list, zip(*pairs)), 0.8).tolist() == want
    assert len(judged) < len(pairs) / 2


def test_one_large_group(spark):
    base = "a line that very many documents share with one small change number "
    docs = spark.createDataFrame([(i, base + str(i)) for i in range(3000)], "doc_id long, text string").repartition(6)
    got = lines.without_duplicate_lines(docs)
    assert [r.doc_id for r in got.where("text != ''").collect()] == [0]


def test_copies_inside_a_family_of_a_template(spark, monkeypatch):
    """Lines of a family are 0.7 to 0.79 alike and share bands; what bands and sketches offer of their changed copies is found."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = "this notice may be used under the terms of the licence that the holder of all rights has given to every reader of the work"
    own = [f"{base} {word()} {word()} {word()}" for _ in range(200)]
    assert all(0.7 < lines.jaccard(own[0], s) < 0.79 for s in own[1:])
    rows, want = list(enumerate(own)), set()
    for i, s in enumerate(own):
        changed = list(s)
        for _ in range(3):
            changed[rng.randrange(len(s))] = "z"
        rows.append((1000 + i, "".join(changed)))
        x, y = lines.signatures([s, rows[-1][1]])
        close = bin(int(x[-1] ^ y[-1])).count("1") <= lines.APART
        if lines.jaccard(s, rows[-1][1]) >= 0.8 and (x[:-1] == y[:-1]).any() and close:
            want.add(1000 + i)
    assert len(want) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(lines, "BLOCK", 32)
    assert {r.doc_id for r in lines.without_duplicate_lines(docs).where("text = ''").collect()} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, "one same line here"), (5, "one same line here"), (6, "one same line here"), (7, None)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.without_duplicate_lines(docs).collect() if r.doc_id != 7)
    assert got == [(5, "one same line here"), (5, "one same line here"), (6, "")]
    assert lines.without_duplicate_lines(docs.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "\n".join(f"line number {i} of a long text {i * i}" for i in range(40_000)))], "doc_id long, text string")
    assert lines.without_duplicate_lines(long).count() == 1


def test_names_of_its_own_columns(spark):
    """Columns named like those the operator works with come back as they were."""
    rows = [(1, "one line of text here", "a", "b", "c"), (2, "one line of text here\nand another", "d", "e", "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _k1 string, _k2 string, _gone string")
    got = sorted(tuple(r) for r in lines.without_duplicate_lines(frame).collect())
    assert got == [(1, "one line of text here", "a", "b", "c", None), (2, "and another", "d", "e", "f", [0])]


def test_pairs_of_rows_in_any_order():
    """A task sorts its rows of bands itself; Spark's sort of every row took most of the time of the stage."""
    rng = np.random.default_rng(4)
    rows = np.stack([rng.integers(0, 300, 2000) * 7919, rng.integers(0, 900, 2000), np.zeros(2000, np.int64)], axis=1)

    def found(order):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["band", "h", "sketch"]) for part in np.array_split(rows[order], 7)]
        return pa.Table.from_batches(list(lines._pairs(iter(batches)))).to_pylist()

    want = found(np.lexsort((rows[:, 1], rows[:, 0])))
    assert want == found(rng.permutation(2000)) and len(want) > 2000


def test_common_shingles_of_blocks():
    texts = ["a line of text", "a line of test", "ab", "aaaaaaaaaa", "a line of text, and more of it", "ab"]
    left, right = np.array([2, 3, 4]), np.array([1, 5, 0])
    both, sizes = lines._overlaps(texts, left, right)
    sets = [lines._shingles(s) for s in texts]
    assert sizes.tolist() == [len(x) for x in sets]
    assert both.tolist() == [[len(sets[i] & sets[j]) for j in right] for i in left]


def test_documents_that_lose_nothing_are_not_shuffled(spark):
    rows = [(i, f"{i} a line that is no other line {i * 7919} at all") for i in range(400)]
    rows += [(1000 + i, "the same line of both of them\n" + str(i) * 9) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.without_duplicate_lines(docs)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in rows)
    assert "Union" in got._jdf.queryExecution().toString() and {r.doc_id for r in got.where("size(_gone) > 0").collect()} == {1001}


def test_plain_form_of_odd_spaces():
    odd = ["", " ", "A  b", " a", "a ", "a\tb", "a\u00a0B", "\u3000x", "x\u2028y", "a\x1cb", "a\x85b", "\u1680", "x\u200by", "\u0130 \u0391\u03a3", "one two"]
    assert [lines.plain(s) for s in odd] == [" ".join(s.lower().split()) for s in odd]


def test_ranges_of_bands():
    """Rows travel packed by ranges of (band, line); a band of very many lines goes over several."""
    rng = np.random.default_rng(5)
    h = np.arange(3000) * 104729 - 10 ** 8
    keys = rng.integers(-2 ** 62, 2 ** 62, (3000, lines.BANDS + 1))
    keys[:2000, 3] = 77  # one band of 2,000 lines
    rows = [(b, x) for x, k in zip(h.tolist(), keys.tolist()) for b in k[:-1]]
    edges = np.array(sorted(rows[::680] + [(77, x) for x in h[100:2000:300].tolist()]))
    table = type("Table", (), {"value": edges})
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i::4]), lines.packed(keys[i::4])], ["h", "bands"]) for i in range(4)]
    packs = pa.Table.from_batches(list(lines._ranges(table)(iter(batches))))
    assert packs.num_rows == len(set(packs.column("range").to_pylist())) > 40
    got = []
    for at, one in zip(packs.column("range").to_pylist(), packs.column("rows").chunk(0)):
        part = np.frombuffer(one.as_py(), np.int64).reshape(-1, 3)[:, :2].tolist()
        assert all(sum(tuple(e) <= tuple(r) for e in edges.tolist()) == at for r in part[::50])
        got += map(tuple, part)
    assert sorted(got) == sorted(rows)
    spread = [p for p, r in zip(packs.column("rows").to_pylist(), packs.column("range").to_pylist()) if 77 in np.frombuffer(p, np.int64)[::3]]
    assert len(spread) >= 7
    members = [r for p in spread for part in lines._range_pairs(iter([pa.record_batch({"rows": pa.array([p], pa.binary())})]))
               for r in part.to_pylist() if r["band"] == 77 and r["b"] is None]
    assert sorted(r["a"] for r in members) == h[:2000].tolist()


def test_many_small_bands_at_once():
    rng = random.Random(8)
    texts, bands = [], []
    for band in range(30):
        base = "".join(rng.choice("abcdefgh ") for _ in range(200))
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(200)
            texts.append(base[:at] + rng.choice("xyz") * rng.randrange(1, 40) + base[at:])
            bands.append(band)
    keys = lines.signatures(texts)
    keys[:, 0] = bands
    rows = pa.table({"band": bands, "lo": [0] * len(bands), "hi": [0] * len(bands), "block": [0] * len(bands), "h": list(range(len(bands))),
                     "c": [i // 2 for i in range(len(bands))], "line": texts, "keys": lines.packed(keys)})
    one_by_one = [lines._near(rows.filter(pa.array(np.array(bands) == b)), 0.8) for b in range(30)]
    want = {(a, b) for part in one_by_one for a, b in zip(*map(np.ndarray.tolist, part))}
    assert {(a, b) for a, b in zip(*map(np.ndarray.tolist, lines._near_in_small(rows, 0.8)))} == want and len(want) > 50
    assert not len(lines._near_in_small(rows.slice(0, 0), 0.8)[0])


def test_rows_of_bands_are_few_rows_of_spark(spark):
    """Nine rows a line went through Spark's shuffle and most of its time there."""
    docs = spark.createDataFrame([(i, f"{i} a line like no other {i * 7919}") for i in range(5000)], "doc_id long, text string").repartition(2)
    keyed = lines.keyed(docs, "k1", "k2").select("doc_id", "k1", "k2", "text")
    signed = lines.cut_lineage(keyed.mapInArrow(
        lines._line_rows, "doc_id long, k1 long, k2 long, line int, h long, bands binary, picked binary"))
    edges = spark.sparkContext.broadcast(lines.edges_of(signed.where("picked IS NOT NULL").select("h", "picked"), 8))
    packs = signed.where("bands IS NOT NULL").select("h", "bands").mapInArrow(lines._ranges(edges), "range long, rows binary")
    assert packs.count() <= 50 and packs.selectExpr("sum(length(rows))").first()[0] == 5000 * lines.BANDS * 24


def test_a_task_hands_on_a_text_once():
    table = type("Table", (), {"value": np.full(1 << lines.TABLE - 6, 2 ** 64 - 1, np.uint64)})
    batches = [pa.record_batch({"text": pa.array(["one line\nand another", "One  line"])}), pa.record_batch({"text": pa.array(["one line\nmore", None])})]
    got = [s for b in lines._line_texts(table)(iter(batches)) for s in b.column("line").to_pylist()]
    assert got == ["one line", "and another", "more"]
