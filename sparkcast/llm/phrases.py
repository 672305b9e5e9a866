"""Phrases whose words come together more often than apart, found best first.

A phrase that begins with ``p`` scores at most 1000 n / f(p): cut it after ``p`` and the whole is no more frequent than its rest. Of the
prefixes of a phrase the first word has the least bound. So the frontier of unexpanded first words is opened from the rarest on: a wave
grows all phrases that begin with its words, a word at a time, as long as they are frequent. When as many phrases have survived as are
wanted, their last score tells which words a better or equal one could still begin with; these are the next wave, and when there
are none, the language is settled.

The corpus is read twice: for the words, and to write it anew as hashes of its frequent words. Everything else is counted on that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcast.llm import bits
from sparkcast.llm.skew import loose
from sparkcast.session import cut_lineage

LONGEST = 5
WAVE = 4000  # first words of the first wave of a language; a wave that can't tell is followed by one of four times as many
ROW = 128  # hashes of a row of the written corpus that phrases may begin at; those that only end phrases follow
SLICE = 1 << 12  # such rows that are walked at a time
BLOCK = 1 << 20  # bytes of text that are hashed at a time
HELD = 1 << 17  # distinct words, or hashes, that a task gathers before it hands them on
COUNTED = 1 << 20  # places of phrases that are counted together
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
_KINDS = np.zeros(256, np.uint8)  # of bytes: 0 of words, 1 between words, 2 between pieces
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_FACTOR = 0x5851F42D4C957F2D  # odd, so that its powers have inverses


def _powers(factor: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, factor, np.uint64)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class _Hashers(dict):
    """The ``_Words`` of each language that a task meets."""

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, lang: str) -> _Words:
        found = self[lang] = _Words(lang, self.seed)
        return found


class _Words:
    """Words of a language in UTF-8, hashed many at a time: sums of a number for each byte times a power of its place."""

    def __init__(self, lang: str, seed: int) -> None:
        start = np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed))
        self.salt, self.numbers = start, _mixed(np.arange(256, dtype=np.uint64) * np.uint64(_FACTOR) + start)
        self.up, self.down = _powers(_FACTOR, BLOCK), _powers(pow(_FACTOR, -1, 1 << 64), BLOCK)

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """None of them is zero, which parts pieces."""
        if len(data) > len(self.up):
            self.up, self.down = _powers(_FACTOR, len(data)), _powers(pow(_FACTOR, -1, 1 << 64), len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.numbers[data] * self.up[:len(data)])])
        words = (sums[stops] - sums[starts]) * self.down[starts]
        return np.maximum(_mixed(words ^ (stops - starts).astype(np.uint64) * self.salt), np.uint64(1))


def _words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a block start and stop, and which of them another piece comes after."""
    kinds = _KINDS[data]
    edges = np.diff(np.concatenate([[0], (kinds == 0).view(np.int8), [0]]))
    starts, stops = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    ends = np.append(0, np.cumsum(kinds == 2))
    return starts, stops, ends[np.append(starts[1:], len(data))[:len(starts)]] != ends[stops]


def _blocks(texts: list[str | None]) -> Iterator[bytes]:
    """The texts, A-Z in lower case, as blocks of about ``BLOCK`` bytes that end before a word; a piece ends with its text."""
    data = b".".join((t or "").encode().lower() for t in texts) + b"."
    start = 0
    while start < len(data):
        stop = min(len(data), start + BLOCK)
        while stop < len(data) and (_KINDS[data[stop - 1]] == 0 or _KINDS[data[stop]]):
            stop += 1
        yield data[start:stop]
        start = stop


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    """The texts of a language in groups of about ``BLOCK`` characters."""
    for batch in batches:
        held: dict[str, list] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, []).append(text.as_py())
            sizes[lang] += len(held[lang][-1] or "")
            if sizes[lang] >= BLOCK:
                yield lang, held.pop(lang)
                del sizes[lang]
        yield from held.items()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashers = _Hashers(0)
    held: dict[str, dict[int, list]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            counts, words = zip(*found.values())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()),
                                              pa.array(counts, pa.int64())], ["lang", "word", "n"])
        held.clear()

    for lang, texts in _by_language(batches):
        hasher = hashers[lang]
        for block in _blocks(texts):
            data = np.frombuffer(block, np.uint8)
            starts, stops, _ = _words_at(data)
            if not len(starts):
                continue
            h, first, counts = np.unique(hasher.hashes(data, starts, stops), return_index=True, return_counts=True)
            found = held.setdefault(lang, {})
            for key, i, j, n in zip(h.tolist(), starts[first].tolist(), stops[first].tolist(), counts.tolist()):
                if key in found:
                    found[key][0] += n
                else:
                    found[key] = [n, block[i:j]]
        if sum(map(len, held.values())) > HELD:
            yield from out()
    yield from out()


def _with_hashes(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _Hashers(seed)
        for batch in batches:
            h = np.array([hashers[lang].hashes(
                np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(word.encode())]))[0]
                for lang, word in zip(*(c.to_pylist() for c in batch.columns[:2]))], np.uint64)
            grams = pa.array([x.tobytes() for x in h], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, grams, pa.array(_fold([h]).view(np.int64))], ["lang", "word", "f", "gram", "h"])

    return run


def _fold(words: list[np.ndarray]) -> np.ndarray:
    """One hash for the phrase of the words at the same place of each array."""
    folded = np.full(len(words[0]), np.uint64(0x243F6A8885A308D3))
    for w in words:
        folded = (folded ^ w) * np.uint64(0x9FB21C651E98DF25)
        folded ^= folded >> np.uint64(29)
    return folded


def _beside(flat: np.ndarray) -> np.ndarray:
    """Whether a word is just before or after a place."""
    word = np.concatenate([[False], flat != 0, [False]])
    return word[:-2] | word[2:]


def _encode(table, seed: int):
    """``(lang, own, seg)``: the texts as hashes of words that may be frequent. Zeros stand for what parts them; a phrase counts in the row
    where it begins among the first ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _Hashers(seed)
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                flat = np.concatenate(parts)
                flat = flat[(flat != 0) | _beside(flat)]  # words, and ends beside words
                flat = flat[(flat == 0) | _beside(flat)]  # no words that stand alone
                starts = np.arange(0, len(flat), ROW)
                stops = np.minimum(starts + ROW + LONGEST - 1, len(flat))
                offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
                values = np.concatenate([flat[i:j] for i, j in zip(starts.tolist(), stops.tolist())] or [flat]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), pa.array(np.full(len(starts), ROW, np.int32)),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["lang", "own", "seg"])
            held.clear()

        size = 0
        for lang, texts in _by_language(batches):
            hasher = hashers[lang]
            for block in _blocks(texts):
                data = np.frombuffer(block, np.uint8)
                starts, stops, after = _words_at(data)
                found = hasher.hashes(data, starts, stops)
                found[~bits.held(table.value, _fold([found]))] = 0
                places = np.arange(len(found)) + np.concatenate([[0], np.cumsum(after)[:-1]])[:len(found)]
                spaced = np.zeros(len(found) + int(after.sum()), np.uint64)
                spaced[places] = found
                held.setdefault(lang, []).append(spaced)
                size += len(found)
            if size > HELD:
                yield from out()
                size = 0
        yield from out()

    return run


def _distinct(grams: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the hash of each, and how often it occurs."""
    order = np.argsort(h)
    rows, hashes = grams[order], h[order]
    differ = (rows[1:] != rows[:-1]).any(axis=1)
    if (differ & (hashes[1:] == hashes[:-1])).any():  # different rows of one hash needn't lie apart
        order = np.lexsort(grams.T)
        rows, hashes = grams[order], h[order]
        differ = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.concatenate([[0], np.nonzero(differ)[0] + 1])
    return rows[starts], hashes[starts], np.diff(np.append(starts, len(rows)))


def _grams(jobs: list[tuple[int, int, int]], tables):
    """Counts of phrases: for each job ``(k, lo, hi)`` of those of ``k`` words whose words from ``lo`` to ``hi`` its table may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in jobs]
        sizes = [0] * len(jobs)

        def out(job: int, lang: str, found: list[tuple]) -> pa.RecordBatch:
            k = jobs[job][0]
            rows, h, counts = _distinct(np.concatenate([x for _, x, _ in found]), np.concatenate([x for *_, x in found]))
            ends = np.arange(0, 8 * k * len(rows) + 1, 8 * k, dtype=np.int32)
            grams = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), job, np.int32)), pa.array([lang] * len(rows), pa.string()), grams,
                                               pa.array(h.view(np.int64)), pa.array(counts)], ["job", "lang", "gram", "h", "n"])

        def flush(job: int) -> Iterator[pa.RecordBatch]:
            for lang in {x for x, *_ in held[job]}:
                yield out(job, lang, [x for x in held[job] if x[0] == lang])
            held[job], sizes[job] = [], 0

        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            segs = batch.column(2)
            flat, ends = segs.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(segs.value_lengths().to_numpy(zero_copy_only=False))
            if not len(flat):
                continue
            rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            at = np.arange(len(flat))
            stop = np.minimum.accumulate(np.where(flat == 0, at, len(flat))[::-1])[::-1]
            length = np.minimum(stop, ends[rows]) - at
            length[at - np.append(0, ends[:-1])[rows] >= batch.column(1).to_numpy(zero_copy_only=False)[rows]] = 0
            names, lang_of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for job, (k, lo, hi) in enumerate(jobs):
                places = np.nonzero(length >= k)[0]
                places = places[bits.held(tables.value[job], _fold([flat[places + i] for i in range(lo, hi)]))]
                for number, lang in enumerate(names):
                    own = places if len(names) == 1 else places[lang_of[rows[places]] == number]
                    if len(own):
                        grams = np.stack([flat[own + i] for i in range(k)], axis=1)
                        held[job].append((lang, grams, _fold(list(grams.T))))
                        sizes[job] += len(own)
            if sum(sizes) >= COUNTED:
                yield from flush(int(np.argmax(sizes)))
        for job in range(len(jobs)):
            if held[job]:
                yield from flush(job)

    return run


def _counted(corpus: DataFrame, jobs: list[tuple[int, int, int]], wanted: list[DataFrame], least: int) -> DataFrame:
    """``(job, lang, gram, h, f)`` of the phrases that ``_grams`` finds by the hashes (``h``) wanted for each job, ``least`` times or more."""
    tables = corpus.sparkSession.sparkContext.broadcast([bits.build(w.select("h"), w.count()) for w in wanted])
    rows = corpus.mapInArrow(_grams(jobs, tables), "job int, lang string, gram binary, h long, n long")
    return cut_lineage(rows.groupBy("job", "lang", "gram").agg(F.min("h").alias("h"), F.sum("n").alias("f")).where(F.col("f") >= least))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [int(_fold(list(np.frombuffer(g, np.uint64)[:, None]))[0].view(np.int64)) for g in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int64())], ["lang", "gram", "h"])


def _words_in(gram: Column) -> Column:
    return (F.octet_length(gram) / 8).cast("int")


def _part(gram: Column, start: Column | int, words: Column | int) -> Column:
    """``words`` words of a phrase from word ``start`` on, from 0."""
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(gram, whole(start) * 8 + 1, whole(words) * 8)


def _grown(corpus: DataFrame, first: DataFrame, least: int) -> list[DataFrame]:
    """Frequent phrases of 2 words, of 3 and so on that begin with the words ``first``."""
    found, prefix = [], first
    for k in range(2, LONGEST + 1):
        longer = _counted(corpus, [(k, 0, k - 1)], [prefix], least)
        begun = longer.withColumn("prefix", _part(F.col("gram"), 0, k - 1)).join(
            loose(prefix.select("lang", F.col("gram").alias("prefix"))), ["lang", "prefix"], "left_semi")
        prefix = cut_lineage(begun.select("lang", "gram", "h", "f"))
        if prefix.isEmpty():
            break
        found.append(prefix)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _suffixes(grown: DataFrame) -> DataFrame:
    """What follows a cut of the phrases, where it is a phrase itself."""
    k = _words_in(F.col("gram"))
    cut = grown.where(k > 2).select("lang", "gram", F.explode(F.sequence(F.lit(1), k - 2)).alias("cut"))
    return cut.select("lang", _part(F.col("gram"), F.col("cut"), LONGEST).alias("gram")).distinct()


def _judged(grown: DataFrame, counts: DataFrame, totals: DataFrame, inside: DataFrame) -> DataFrame:
    """``(lang, gram, a, l, r, n, score)`` of the phrases that no longer one holds; ``counts`` has ``lang, gram, f`` of all parts."""
    cut = grown.select("lang", "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), _words_in(F.col("gram")) - 1)).alias("k"))
    cut = cut.withColumns({"left": _part(F.col("gram"), 0, F.col("k")), "right": _part(F.col("gram"), F.col("k"), LONGEST)})
    lefts, rights = (counts.select("lang", F.col("gram").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    cut = cut.join(loose(lefts), ["lang", "left"]).join(loose(rights), ["lang", "right"]).join(loose(totals.select("lang", "n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    least = cut.groupBy("lang", "gram").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "a", "l", "r", "n")).alias("s"))
    return least.select("lang", "gram", "s.a", "s.l", "s.r", "s.n", "s.score").join(loose(inside), ["lang", "gram"], "left_anti")


def _inside(grown: DataFrame, before: DataFrame) -> DataFrame:
    """Phrases that occur only with one and the same word after them, or before them (``before``: phrases with a word before)."""
    after = grown.select("lang", _part(F.col("gram"), 0, _words_in(F.col("gram")) - 1).alias("gram"), "f")
    led = before.select("lang", _part(F.col("gram"), 1, LONGEST).alias("gram"), "f")
    longer = after.unionByName(led).groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    return grown.join(loose(longer), ["lang", "gram"]).where("longer = f").select("lang", "gram")


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    Texts, A-Z in lower case, are cut into pieces at ``.,;:!?`` and line ends, these into words at spaces and tabs. A phrase is 2 to 5
    words in a row of a piece, ``least`` or more times (``a``); ``n`` is the words of the language. Cut after its first words, the parts
    occur ``l`` and ``r`` times; it scores floor(1000 a n / (l r)) for the cut with the least score, the first of these. A phrase that
    occurs only inside one and the same longer one is left out. They go by score, then ``a``, falling, then phrase.
    A NULL language is ``und``, a NULL text is empty; repeated rows count each; other columns are not read. An empty
    table, or one without frequent words, gives an empty result. Runs jobs when called.

    Words are told apart by 64-bit hashes: those of frequent words are known to differ, a rare word that has the hash of one of
    n frequent ones (n / 2^64 for each) would count as that.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = cut_lineage(read.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    common, seed = words.where(F.col("f") >= least), 0
    while True:
        vocabulary = cut_lineage(common.mapInArrow(_with_hashes(seed), "lang string, word string, f long, gram binary, h long"))
        size, apart = vocabulary.agg(F.count("*"), F.count_distinct("h")).first()
        if size == apart:
            break
        seed += 1
    if not size:
        return spark.createDataFrame([], RESULT)
    table = spark.sparkContext.broadcast(bits.build(vocabulary.select("h"), size))
    corpus = cut_lineage(read.mapInArrow(_encode(table, seed), "lang string, own int, seg array<long>"))
    rarest = vocabulary.groupBy("lang").agg(F.max("f").alias("most"))
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("f").alias("n")).join(rarest, "lang"))  # a row for each language

    open_, wave = totals.select("lang", F.lit(0).cast("long").alias("done")), WAVE
    limits, grown, extra, judged = _limits(vocabulary, open_, wave), [], [], None
    while True:
        first = cut_lineage(vocabulary.join(loose(limits), "lang").where("f > done AND f <= goal").select("lang", "gram", "h", "f"))
        fresh = _grown(corpus, first, least)
        if fresh:
            grown += fresh
            new, known = _union(fresh), _union(grown + extra)
            missing = _suffixes(new).join(loose(known.select("lang", "gram")), ["lang", "gram"], "left_anti")
            missing = cut_lineage(missing.mapInArrow(_hashed, "lang string, gram binary, h long"))
            sizes = range(2, LONGEST)
            of = lambda frame, k: frame.where(_words_in(F.col("gram")) == k)
            jobs = [(k, 0, k) for k in sizes] + [(k + 1, 1, k + 1) for k in sizes]
            more = _counted(corpus, jobs, [of(missing, k) for k in sizes] + [of(new, k) for k in sizes], least)
            parts = more.where(F.col("job") < len(sizes)).join(loose(missing.select("lang", "gram")), ["lang", "gram"], "left_semi")
            extra.append(parts.select("lang", "gram", "h", "f"))
            counts = _union([x.select("lang", "gram", "f") for x in [vocabulary, *grown, *extra]])
            inside = _inside(new, more.where(F.col("job") >= len(sizes)))
            good = cut_lineage(_judged(new, counts, totals, inside))
            judged = good if judged is None else judged.unionByName(good)
        limits = cut_lineage(_unsettled(limits, totals, judged, top, vocabulary, wave := 4 * wave))
        if limits.isEmpty():
            break
    if judged is None:
        return spark.createDataFrame([], RESULT)
    return _ranked(judged, vocabulary, top)


def _limits(vocabulary: DataFrame, open_: DataFrame, wave: int) -> DataFrame:
    """``(lang, done, goal)``: the words up to ``done`` are expanded, the ``wave`` next ones (and those as frequent) go up to ``goal``."""
    left = vocabulary.join(loose(open_), "lang").where("f > done")
    place = F.row_number().over(W.partitionBy("lang").orderBy("f"))
    return left.withColumn("place", place).where(F.col("place") <= wave).groupBy("lang").agg(F.max("done").alias("done"), F.max("f").alias("goal"))


def _unsettled(limits: DataFrame, totals: DataFrame, judged: DataFrame | None, top: int, vocabulary: DataFrame, wave: int) -> DataFrame:
    """The limits of the languages that an unexpanded word may still give a phrase as good as the last of the first ``top``."""
    now = limits.select("lang", F.col("goal").alias("done")).join(totals, "lang").where("done < most")
    if judged is None:
        return _limits(vocabulary, now.select("lang", "done"), wave)
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score")))
    last = judged.select("lang", "score").withColumn("place", place).where(F.col("place") <= top).where(F.col("place") == top)
    told = now.join(last.select("lang", "score"), "lang", "left")
    # floor(1000 n / f) >= score, as long as f <= 1000 n / score; a score of 0 lets all words in
    reach = F.when(F.col("score") > 0, F.least(F.call_function("div", F.lit(1000).cast("decimal(19,0)") * F.col("n"), F.col("score").cast("decimal(19,0)")),
                                               F.col("most"))).otherwise(F.col("most")).cast("long")
    known = told.where("score IS NOT NULL").select("lang", "done", reach.alias("goal")).where("goal > done")
    return known.unionByName(_limits(vocabulary, told.where("score IS NULL").select("lang", "done"), wave))


def _ranked(judged: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their words."""
    by = [F.desc("score"), F.desc("a")]
    tied = judged.withColumn("tied", F.rank().over(W.partitionBy("lang").orderBy(*by))).where(F.col("tied") <= top).drop("tied")
    each = tied.select("lang", F.col("gram").alias("whole"), F.explode(F.sequence(F.lit(0), _words_in(F.col("gram")) - 1)).alias("at"))
    each = each.withColumn("gram", _part(F.col("whole"), F.col("at"), 1)).join(loose(vocabulary.select("lang", "gram", "word")), ["lang", "gram"])
    said = each.groupBy("lang", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    said = said.select("lang", F.col("whole").alias("gram"), F.array_join(F.col("words.word"), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*by, "phrase")).cast("long")
    found = tied.join(said, ["lang", "gram"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
