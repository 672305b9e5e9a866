"""Removal of word windows that occur more than once in a corpus.

Every window of ``window`` words has a Rabin-Karp hash. A window repeats only if the 8-word gram with the smallest hash inside it
repeats, so these anchor grams, one position in about fourteen, are counted first; all windows whose anchor occurs once are
settled by that. The hashes of all others are counted in Spark and the repeated ones merged into maximal intervals.
Equal texts are handled once, with their number of copies.

Hashes have 64 bits: among n windows about n^2 / 2^65 pairs are taken for equal that aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.skew import loose
from sparkcast.llm.words import word_blocks
from sparkcast.session import cut_lineage

GRAM = 8
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def word_numbers(text: str | None) -> np.ndarray:
    """A 64-bit number for each word of a text."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
             for words in word_blocks((text or "").encode())]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as long as the longest text of the task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 14)
            steps = np.ones(n, np.uint64)
            steps[1:] = _BASE
            self.up = np.cumprod(steps)
            steps[1:] = _UNBASE
            self.down = np.cumprod(steps)


def rolling(numbers: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every run of ``width`` numbers."""
    n = len(numbers)
    if n < width:
        return np.empty(0, np.uint64)
    powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(numbers * powers.down[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * powers.up[width - 1:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every run of ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(numbers: np.ndarray, window: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and the smallest gram hash of each window."""
    grams = _mixed(rolling(numbers, GRAM, powers))
    return grams, _sliding(grams, window - GRAM + 1, np.minimum)


def _twice(values: np.ndarray) -> np.ndarray:
    """Each value once, or twice if it is there more than once: all that counting needs to know of one text."""
    found, n = np.unique(values, return_counts=True)
    return np.concatenate([found, found[n > 1]]).view(np.int64)


def anchor_grams(text: str | None, window: int, powers: _Powers) -> np.ndarray:
    numbers = word_numbers(text)
    if len(numbers) < window:
        return np.empty(0, np.int64)
    grams, least = anchors(numbers, window, powers)
    reach = window - GRAM + 1
    edge = np.zeros(reach - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, least, edge]), reach, np.maximum) == grams
    return _twice(grams[chosen])


def candidate_windows(text: str | None, window: int, repeated: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of the windows whose anchor is among ``repeated``."""
    numbers = word_numbers(text)
    _, least = anchors(numbers, window, powers)
    return _twice(rolling(numbers, window, powers)[np.isin(least, repeated)])


def covered(text: str | None, window: int, repeated: np.ndarray, powers: _Powers) -> np.ndarray:
    """Which words a window among ``repeated`` covers."""
    numbers = word_numbers(text)
    starts = np.isin(rolling(numbers, window, powers), repeated)
    change = np.zeros(len(numbers) + 1, np.int64)
    change[:len(starts)] += starts
    change[window:window + len(starts)] -= starts
    return np.cumsum(change[:-1]) > 0


def _spans(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]


def _kept(text: str | None, mask: np.ndarray | None) -> tuple[int, bytes]:
    """The number of words of a text, and those not masked joined by one space."""
    n, parts = 0, []
    for words in word_blocks((text or "").encode()):
        if mask is None:
            parts.append(b" ".join(words))
        else:
            here = [w for w, gone in zip(words, mask[n:n + len(words)].tolist()) if not gone]
            if here:
                parts.append(b" ".join(here))
        n += len(words)
    return n, b" ".join(parts)


def _longs(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values).view(np.uint64)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            found = [anchor_grams(t.as_py(), window, powers) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["k1", "k2", "grams"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            texts, hits = batch.column(4), batch.column(5)
            found = [candidate_windows(texts[i].as_py(), window, _longs(hits, i), powers) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))],
                                             ["k1", "k2", "class", "copies", "windows"])

    return run


def _result_rows(window: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            texts, copied, hits = batch.column(1), batch.column(2), batch.column(3)
            rows: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                text, mask = texts[i].as_py(), None
                if copied[i].as_py():
                    numbers = sum(map(len, word_blocks((text or "").encode())))
                    mask = np.ones(numbers, bool)
                elif hits[i].is_valid:
                    mask = covered(text, window, _longs(hits, i), powers)
                n, kept = _kept(text, mask)
                for part, value in zip(rows, (n, int(mask.sum()) if mask is not None else 0,
                                              _spans(mask) if mask is not None else [], kept.decode())):
                    part.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], spans),
                 pa.array(rows[3], pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return run


def _repeated(values: DataFrame, name: str) -> DataFrame:
    return loose(values.groupBy(name).count().where("count > 1"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept)`` for every row of ``docs``.

    Every word is removed that is covered by a window of ``window`` words whose sequence also starts anywhere else in the
    corpus, in the same document too; ``removed`` lists the maximal intervals of removed words (stop exclusive), ``kept`` is
    the rest joined by one space. Windows are judged on the input. NULL texts and texts without words have no words and an
    empty ``kept``; repeated rows are documents of their own; NULL ids stay. An empty table gives an empty result.
    Other columns are not read. Runs jobs when called.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    anchored = base.select("k1", "k2", "text").mapInArrow(_anchor_rows(window), "k1 long, k2 long, grams array<long>")
    classes = (anchored.where(F.size("grams") > 0).groupBy("k1", "k2")
               .agg(F.count("*").alias("copies"), F.first("grams").alias("grams")))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    grams = _repeated(classes.select(F.explode("grams").alias("gram")), "gram")
    hits = (classes.select("class", F.explode(F.array_distinct("grams")).alias("gram")).join(grams, "gram")
            .groupBy("class").agg(F.collect_list("gram").alias("hits")))
    hits = classes.select("k1", "k2", "class", "copies").join(hits, "class")
    texts = base.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = cut_lineage(
        hits.join(texts, ["k1", "k2"]).select("k1", "k2", "class", "copies", "text", "hits")
        .mapInArrow(_window_rows(window), "k1 long, k2 long, class long, copies long, windows array<long>"))
    windows = _repeated(found.select(F.explode("windows").alias("h")), "h")
    single = found.where("copies = 1")
    hit = (single.select("class", F.explode(F.array_distinct("windows")).alias("h")).join(windows, "h")
           .groupBy("class").agg(F.collect_list("h").alias("hits")))
    partly = single.select("k1", "k2", "class").join(hit, "class").select("k1", "k2", F.lit(False).alias("copied"), "hits")
    wholly = classes.where("copies > 1").select("k1", "k2", F.lit(True).alias("copied"),
                                                F.lit(None).cast("array<long>").alias("hits"))
    judged = base.join(partly.unionByName(wholly), ["k1", "k2"], "left")
    return judged.select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "hits").mapInArrow(
        _result_rows(window),
        "doc_id long, n_words long, n_removed long, removed array<struct<start: long, stop: long>>, kept string")
