import random

from sparkcast.llm import quality


def plain(text):
    text = text or ""
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0D]+", text)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "one", "a b c d e f g h", "the " * 40, "x\n\nx\nx \n x", "\n".join(["the same line of it"] * 9), "## ** $% &|<>"]
    phrase = [f"p{i}" for i in range(12)]
    for n in (10, 30, 80, 200):
        for _ in range(8):
            words = [rng.choice(["the", "of", "Wörter", "été", "é🙂", "and", f"w{rng.randrange(90)}"]) for _ in range(n)]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(n):0] = phrase[:rng.randrange(6, 13)]
            out.append("".join(w + rng.choice([" ", " ", "\n", "\t", " \r\x0b\x0c"]) for w in words))
    return out


def test_counts(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "the end", 1), (3, "one", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    for r, (_, t, _) in zip(sorted(quality.judge(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id)),
                            sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0)).collect() == []


def test_rules(spark):
    clean = " ".join(f"the {w} of a" for w in "house garden river stone cloud winter letter morning window".split())
    bad = {"symbols": " ".join(w + "###" for w in clean.split()), "shout": " ".join(w + "!!" for w in clean.split()),
           "no stop words": " ".join(f"word{i}" for i in range(50))}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([clean, *bad.values()])], "doc_id long, text string")
    assert [r.kept for r in quality.judge(docs).orderBy("doc_id").collect()] == [True, False, False, False]


def test_very_long(spark):
    text = " ".join(f"the{i % 9973}" for i in range(150_000)) + "\n" + "x " * 20
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 150_020 and row.n_repeat_words == 150_020


def test_native(spark):
    plan = quality.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
