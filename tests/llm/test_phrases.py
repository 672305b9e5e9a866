import random
import re
from collections import Counter

from sparkcast.llm import phrases


def brute(rows, top, least):
    words, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i:i + k])] = counts.get((lang, tuple(ws[i:i + k])), 0) + 1
    out = []
    for lang, n in words.items():
        good = {g: a for (x, g), a in counts.items() if x == lang and a >= least}
        inside = set()
        for g, a in good.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if (i, j) != (0, len(g)) and 100 * a >= 100 * good.get(g[i:j], 1 << 60):
                        inside.add(g[i:j])
        found = []
        for g, a in good.items():
            if len(g) > 1 and g not in inside:
                s, k = min((1000 * a * n // (good[g[:k]] * good[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), good[g[:k]], good[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out)


def result(spark, rows, top, least):
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, n int, gram string")
    return sorted(tuple(r) for r in phrases.collocations(frame.repartition(3), top, least).collect())


def corpus(rng, langs, docs, vocabulary=60):
    fixed = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(2, 8))) for _ in range(12)]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % vocabulary}")
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r"]))
        rows.append((rng.choice(langs), "".join(parts)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(rng, ["en", "EN", None, "und"], 260) + [("en", None), ("xx", ""), ("one", "The the THE the"), ("one", "É é É é")]
    rows += [("rep", "again and again and again")] * 40
    for top, least in ((2000, 5), (7, 4)):
        assert result(spark, rows, top, least) == brute(rows, top, least)


def test_waves_settle(spark, monkeypatch):
    """Waves of five words: what the first ones can't settle is expanded later, ties included."""
    monkeypatch.setattr(phrases, "WAVE", 5)
    rows = corpus(random.Random(2), ["a", "b"], 150, 40)
    assert result(spark, rows, 5, 6) == brute(rows, 5, 6)


def test_rows_are_cut(spark, monkeypatch):
    """Phrases over the ends of written rows and of task flushes count once."""
    monkeypatch.setattr(phrases, "ROW", 3)
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "COUNTED", 4)
    monkeypatch.setattr(phrases, "BLOCK", 20)
    monkeypatch.setattr(phrases, "SLICE", 2)
    rows = corpus(random.Random(3), ["a", "b"], 60, 15) + [("a", "x y z " * 40)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(frame, 50, 4).collect())
    assert got == brute(rows, 50, 4)


def test_long_text(spark):
    rng = random.Random(4)
    text = " ".join(f"v{rng.randrange(50)}" for _ in range(300_000))
    assert len(text) > 1 << 20
    rows = [("en", text)]
    assert result(spark, rows, 300, 100) == brute(rows, 300, 100)


def test_empty(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(frame).collect() == []
    assert result(spark, [("en", "too rare"), (None, None)], 10, 2) == []
    assert result(spark, [("en", "a. b. a. b.")], 10, 2) == []
