"""SimHash fingerprints and their exact comparison, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcast.llm.batches import giving_back
from sparkcast.llm.components import EDGES, HELD, Links, components, forest
from sparkcast.llm.skew import loose, unused
from sparkcast.llm.words import word_blocks
from sparkcast.session import cut_lineage

BITS = 64
SEED = 42
TILE = 2048
_ROWS = 128  # rows of a tile compared at a time with all of the other


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, A-Z in lower case.

    Fewer words than ``shingle``: the whole sequence is the one shingle. NULL or no words: zero.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):
        words = tail + words
        tail = words[len(words) - shingle + 1:] if len(words) >= shingle else words
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]])
        cuts = zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())
        hashes = list(map(xxhash.xxh64_intdigest, [joined[i:j] for i, j in cuts], repeat(seed)))
        counts += _bit_counts(hashes)
        total += len(hashes)
    if not total:
        if not tail:
            return 0
        counts, total = _bit_counts([xxhash.xxh64_intdigest(b" ".join(tail), seed)]), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; other columns are not read.

    Whole texts, NULL ids stay NULL, repeated rows stay repeated. Texts of NULL or no words have fingerprint zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column, segments: int) -> Column:
    """Population counts of the segments, in one number with a byte for each (counts from 64, so sums of steps never carry)."""
    width = BITS // segments
    mask = F.lit(-1 if width == BITS else (1 << width) - 1)
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(mask)).cast("long") for i in range(segments)]
    return sum(((c + 64) * (1 << 8 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))


def _steps(radius: int, segments: int) -> list[int]:
    """Differences between cells that may hold fingerprints within the radius; of two opposite ones the later."""
    span = range(-radius, radius + 1)
    near = [s for s in product(span, repeat=segments) if sum(map(abs, s)) <= radius]
    return [sum(x << 8 * i for i, x in enumerate(s)) for s in near if s >= (0,) * segments]


def tiles(points: DataFrame, segments: int, tile: int = TILE, packed: Column | None = None) -> DataFrame:
    """``(cell, block, fps)``: rows of ``points`` (or ``packed`` of them) packed by population counts into blocks of about ``tile``."""
    celled = points.withColumn("cell", _cell(F.col("fp"), segments))
    blocks = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    placed = celled.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(*points.columns), F.col("blocks")))
    return placed.groupBy("cell", "block").agg(F.collect_list(F.col("fp") if packed is None else packed).alias("fps"))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values).view(np.uint64) for c in (left, right))
                for at in range(0, len(x), _ROWS):
                    rows = x[at:at + _ROWS]
                    near = np.nonzero(np.bitwise_count(rows[:, None] ^ y[None, :]) <= radius)
                    a, b = rows[near[0]].view(np.int64), y[near[1]].view(np.int64)
                    yield from links.add(a[a != b], b[a != b])
        yield from links.flush()

    return run


def tile_pairs(points: DataFrame, radius: int, segments: int, salts: int = 1, tile: int = TILE,
               packed: Column | None = None) -> DataFrame:
    """``(fps, others)``: every pair of tiles whose population counts allow a distance within the radius, once."""
    whole = cut_lineage(tiles(points, segments, tile, packed).withColumn("salt", F.pmod("block", F.lit(salts))))
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius, segments)])).alias("step")
    left = whole.select("cell", "block", "fps", steps).withColumn("key", F.col("cell") + F.col("step"))
    if salts > 1:
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    else:
        left = left.withColumn("salt", F.lit(0).cast("long"))
    right = whole.select(F.col("cell").alias("key"), "salt", F.col("block").alias("other"), F.col("fps").alias("others"))
    met = left.join(right, ["key", "salt"]).where((F.col("step") != 0) | (F.col("other") >= F.col("block")))
    return met.select("fps", "others")


def linked(points: DataFrame, radius: int = 3, segments: int = 4) -> DataFrame:
    """Forests that connect the same fingerprints as all pairs of ``points`` (distinct ``fp``) within ``radius`` bits."""
    return tile_pairs(points, radius, segments).mapInArrow(_compare(radius), EDGES)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the smallest id reachable, itself
    included. Equal fingerprints are compared once, however many rows share them. Texts of NULL or no words share fingerprint
    zero and are linked like any other; rows with a NULL id take part, and their component is NULL when no member has an id.
    An empty table gives an empty result. Runs jobs when called.
    """
    known = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    points = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(linked(points.select("fp"), radius))
    rooted = points.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return known.join(member, "fp").select("doc_id", "fp", "component_id")


# Whole texts that are similar: wide fingerprints of their distinct shingles, so that random pairs hardly ever meet, and an exact comparison.
SIMILAR = 0.8
WIDE = 4  # words of 64 bits in a wide fingerprint
FIRST, ALL = 20, 68  # bits that the first words, and whole wide fingerprints, of candidates may differ in
TEXTS = 1 << 14  # texts of a tile of wide fingerprints
_CLASSES = 4  # size classes of tiles within the ratio 1 / SIMILAR
_HASHED = 1 << 16  # shingles whose bits are counted at a time
_PAIRS = 32  # pairs of tiles a task compares
HEADS, HEAD_CHARS = 512, 1 << 20  # texts of a component, and their characters, that a round judges by at most; the first by one
JUDGED = 1 << 10  # texts that meet a copy of the heads, about


def _shingles(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def similarity(a: str | None, b: str | None, shingle: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; texts without words are equal to each other."""
    x, y = _shingles(a, shingle), _shingles(b, shingle)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of several independent hashes from one."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def wide_fingerprint(text: str | None, shingle: int = 5) -> list[int]:
    """Number of distinct word shingles, then the words of a SimHash in which each of them counts once; zeros without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * (WIDE + 1)
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]])
    cuts = zip(starts.tolist(), (ends[size - 1:] - 1).tolist())
    hashes = np.unique(np.array([xxhash.xxh3_64_intdigest(joined[i:j]) for i, j in cuts], np.uint64))
    counts = np.zeros((WIDE, BITS), np.int64)
    for at in range(0, len(hashes), _HASHED):
        for k in range(WIDE):
            raw = _mixed(hashes[at:at + _HASHED], k).view(np.uint8).reshape(-1, 8)
            counts[k] += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [len(hashes), *np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.int64).ravel().tolist()]


_WORDS = [f"f{k}" for k in range(WIDE)]


def _wide(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.int64).reshape(-1, WIDE + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, found.T)], ["w", "doc_id", "n", *_WORDS])

    return run


def _pack(rows: pa.Table) -> pa.Table:
    """One row for a tile: the bounds of its sizes and population counts, and its texts as packed numbers."""
    packed = np.stack([rows.column(c).to_numpy() for c in ("w", "n", *_WORDS)], axis=1)
    bits = np.bitwise_count(packed[:, 2].view(np.uint64))
    bounds = {"least": packed[:, 1].min(), "most": packed[:, 1].max(), "low": int(bits.min()), "high": int(bits.max())}
    return pa.table({"class": rows.column("class")[:1], "tile": rows.column("tile")[:1],
                     **{k: pa.array([int(v)], pa.int64()) for k, v in bounds.items()}, "packed": pa.array([packed.tobytes()], pa.binary())})


def wide_tiles(points: DataFrame, similar: float = SIMILAR, texts: int = TEXTS) -> DataFrame:
    """``(class, tile, least, most, low, high, packed)``: ``points`` by size class, then population count, in tiles of ``texts`` to twice as many."""
    step = -np.log(similar) / _CLASSES
    placed = points.withColumns({"class": F.floor(F.log(F.greatest("n", F.lit(1))) / step), "pop": F.bit_count("f0")})
    counts = placed.groupBy("class", "pop").agg(F.count("*").alias("held"))
    earlier = W.partitionBy("class").orderBy("pop").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.select("class", "pop", F.floor(F.coalesce(F.sum("held").over(earlier), F.lit(0)) / texts).alias("block"),
                           F.ceil(F.col("held") / texts).alias("parts"))
    tile = F.col("class") * (1 << 48) + F.col("block") * (1 << 24) + F.pmod(F.xxhash64("w", F.lit(3)), "parts")
    dealt = placed.join(loose(blocks), ["class", "pop"]).select("class", tile.alias("tile"), "w", "n", *_WORDS)
    return dealt.groupBy("tile").applyInArrow(_pack, "class long, tile long, least long, most long, low long, high long, packed binary")


def wide_pairs(tiled: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(a, b)``, a <= b: pairs of tiles that may hold similar texts by the bounds of their sizes and population counts."""
    left = tiled.select(F.explode(F.sequence("class", F.col("class") + _CLASSES + 1)).alias("key"), F.col("tile").alias("a"), "least", "most", "low", "high")
    right = tiled.select(F.col("class").alias("key"), F.col("tile").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("least", "most", "low", "high")))
    # Sizes in the ratio similar, with room for rounding; texts without words have the size 0 and meet those of one shingle.
    sizes = (F.col("least_b") * similar <= F.col("most") + 1) & (F.col("least") * similar <= F.col("most_b") + 1)
    bits = (F.col("low_b") - F.col("high") <= FIRST) & (F.col("low") - F.col("high_b") <= FIRST)
    return left.join(right, "key").where((F.col("a") <= F.col("b")) & sizes & bits).select("a", "b")


def _compare_wide(similar: float):
    def run(pair: pa.Table) -> pa.Table:
        held = {t: np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, WIDE + 2) for t, raw in zip(pair.column("tile").to_pylist(), pair.column("packed"))}
        same = len(held) == 1
        x, y = (held[pair.column(c)[0].as_py()] for c in ("a", "b"))
        (fx, fy), (nx, ny) = ([np.ascontiguousarray(t[:, 2:].T).view(np.uint64) for t in (x, y)], (x[:, 1], y[:, 1]))
        links, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for at in range(0, len(x), 16):
            start = at if same else 0
            near = np.bitwise_count(fx[0, at:at + 16, None] ^ fy[0, None, start:])
            p, q = np.nonzero(near <= FIRST)
            apart = near[p, q].astype(np.int64)
            p, q = p + at, q + start
            for k in range(1, WIDE):
                apart += np.bitwise_count(fx[k, p] ^ fy[k, q])
                close = apart <= ALL
                p, q, apart = p[close], q[close], apart[close]
            total = nx[p] + ny[q]
            fits = similar * np.maximum(nx[p], ny[q]) <= np.minimum(nx[p], ny[q]) + 1e-6
            fits &= (total * (1 - similar) >= (1 + similar) - 1e-6) | (apart == 0)  # else only equal sets of shingles are similar
            a, b = x[p[fits], 0], y[q[fits], 0]
            links.append((a[a != b], b[a != b]))
            size += len(links[-1][0])
            if size >= HELD:
                links = [forest(*map(np.concatenate, zip(*links)))]
                size = len(links[0][0])
        a, b = forest(*map(np.concatenate, zip(*links)))
        return pa.table({"a": a, "b": b})

    return run


def wide_links(points: DataFrame, similar: float = SIMILAR, texts: int = TEXTS) -> DataFrame:
    """Links between candidates among ``points`` (``w, n, f0 ...``). Tiles meet as ids; then a pair at a time gets its two tiles."""
    tiled = cut_lineage(wide_tiles(points, similar, texts))
    pairs = cut_lineage(wide_pairs(tiled, similar))
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // _PAIRS))
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    met = ends.join(tiled.select("tile", "packed"), "tile").repartition(tasks, "a", "b")
    return met.groupBy("a", "b").applyInArrow(_compare_wide(similar), EDGES)


def _sets_alike(x: set[bytes], y: set[bytes], similar: float) -> bool:
    """``similarity`` of two sets of shingles, told by their sizes where these are far apart."""
    if not x or not y:
        return not x and not y
    if min(len(x), len(y)) / max(len(x), len(y)) < similar:
        return False
    both = len(x & y)
    return both / (len(x) + len(y) - both) >= similar


def _staying(similar: float, shingle: int):
    """Heads sorted by component and place: does each stay beside the staying ones before it?"""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            stays = []
            for component, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if component != at:
                    at, held = component, []
                own = _shingles(text.as_py(), shingle)
                stays.append(not any(_sets_alike(own, x, similar) for x in held))
                if stays[-1]:
                    held.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stays, pa.bool_())], ["component", "w", "text", "stays"])

    return run


def _alike(similar: float, shingle: int):
    """Blocks of a component, their heads first: is each other text similar to one of them?"""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            found = []
            for component, block, w, text, head in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4).to_pylist()):
                if (component, block) != at:
                    at, heads = (component, block), []
                own = _shingles(text.as_py(), shingle)
                if head:
                    heads.append(own)
                else:
                    found.append((w, any(_sets_alike(own, x, similar) for x in heads)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.bool_()))], ["w", "alike"])

    return run


def _judge(left: DataFrame, held: DataFrame, most: int, similar: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` texts of each component, ``(component, w, stays)``, and the others, ``(w, alike)``: similar to one of those that stay?"""
    order = W.partitionBy("component").orderBy("place")
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).join(held, "w")
    first = first.withColumn("chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(order)).where((F.col("rank") == 1) | (F.col("chars") <= HEAD_CHARS))
    heads = cut_lineage(first.repartition("component").sortWithinPartitions("component", "rank").select("component", "w", "text")
                        .mapInArrow(_staying(similar, shingle), "component long, w long, text string, stays boolean"))
    others = left.select("component", "w").join(loose(heads.select("w")), "w", "left_anti")
    sizes = loose(others.groupBy("component").agg(F.ceil(F.count("*") / JUDGED).alias("blocks")))
    dealt = others.join(sizes, "component").join(held, "w").select(
        "component", F.pmod(F.xxhash64("w"), "blocks").alias("block"), "w", "text", F.lit(False).alias("head"))
    tops = heads.where("stays").join(sizes, "component").select(
        "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "w", "text", F.lit(True).alias("head"))
    met = dealt.unionByName(tops).repartition("component", "block").sortWithinPartitions("component", "block", F.desc("head"))
    return heads.select("component", "w", "stays"), cut_lineage(met.mapInArrow(_alike(similar, shingle), "w long, alike boolean"))


def copies_of_earlier(texts: DataFrame, similar: float = SIMILAR, shingle: int = 5) -> DataFrame:
    """``(w)`` of the texts that are similar to one that stays; ``texts`` has ``w`` (number of the text), ``doc_id`` and ``text``.

    Texts whose fingerprints are close form components. In each the text with the smallest id stays and takes the similar
    ones away; what is left of the component goes on likewise, until nothing is. So a text only goes for one that stays. A round
    judges by several texts of a component, first among themselves and in order, which comes to the same.
    """
    if similar < SIMILAR:
        raise ValueError(f"the radius of candidates holds for a similarity of {SIMILAR} or more")
    known = texts.mapInArrow(_wide(shingle), f"w long, doc_id long, n long, {', '.join(f'{c} long' for c in _WORDS)}")
    points = cut_lineage(known.groupBy("w").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", *_WORDS))))
    found = components(wide_links(points.select("w", "n", *_WORDS), similar))
    every = found.select("component", F.col("node").alias("w")).unionByName(
        found.select("component", F.col("component").alias("w")).distinct())
    late = F.col("doc_id").isNull()
    left = cut_lineage(every.join(points.select("w", "doc_id"), "w").select("component", "w", F.struct(late.alias("late"), "doc_id", "w").alias("place")))
    held = cut_lineage(texts.select("w", "text").join(loose(left.select("w", "component")), "w").groupBy("w").agg(F.first("text").alias("text")))
    gone, most = [], 1
    while not left.isEmpty():
        heads, others = _judge(left, held, most, similar, shingle)
        gone += [heads.where("NOT stays").select("w"), others.where("alike").select("w")]
        left = cut_lineage(left.join(others.where("NOT alike").select("w"), "w", "left_semi"))
        most = min(HEADS, most * 8)
    if not gone:
        return points.select("w").limit(0)
    whole = gone[0]
    for part in gone[1:]:
        whole = whole.unionByName(part)
    return whole


def first_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no equal or similar one with a smaller id (NULL last) stays.

    Of rows with equal texts one stays, repeated rows too. Texts are similar when their word shingles have at least the Jaccard
    similarity given (0.8 at least); a pair at 0.8 is found with over 99 % probability, short ones too, and none is removed that isn't
    similar to one that stays. A NULL text counts as empty, texts without words are equal. An empty table gives an empty result. Equal
    texts are told by a 64-bit hash. Runs jobs when called.
    """
    w, at = unused(docs, "_w"), unused(docs, "_place")
    plain = docs.withColumn(w, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    place = F.row_number().over(W.partitionBy(w).orderBy(F.col(doc_id).asc_nulls_last()))
    single = plain.withColumn(at, place).where(F.col(at) <= 1)
    texts = plain.select(F.col(w).alias("w"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = cut_lineage(copies_of_earlier(texts, similar, shingle))
    return single.join(gone.withColumnRenamed("w", w), w, "left_anti").select(*docs.columns)
