import random
from collections import Counter

from sparkcast.llm import substrings


def plain(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def run(spark, rows, window):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, k1 int")
    found = substrings.remove_repeats(docs, window=window).collect()
    for r in found:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr)


def test_against_plain_counts(spark):
    rng = random.Random(11)

    def prose(n, size=4000):
        return [f"w{rng.randrange(size)}" for _ in range(n)]

    passage, short = prose(60), prose(14)
    rows = [(0, None), (1, ""), (2, " \n "), (3, " ".join(prose(14)))]
    for i in range(4, 60):
        words = prose(rng.randrange(5, 300))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(20):rng.randrange(30, 60)]
        if i % 5 == 0:
            words += short
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(60, rows[9][1]), (61, rows[9][1]), (9, rows[9][1]), (62, "again " * 200), (63, " ".join(prose(400, 2))), (None, rows[12][1]),
             (64, "Wörter mit é " * 3 + " ".join(passage)), (65, " ".join(prose(200_000)) + " " + " ".join(passage))]
    for window in (15, 35):
        assert run(spark, rows, window) == plain(rows, window)


def test_empty(spark):
    assert run(spark, [], 35) == []
