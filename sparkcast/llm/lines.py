"""Removal of lines that a corpus holds more than once, up to small differences.

Lines are compared in lower case with single spaces. MinHash signatures of their character shingles fall into bands; lines that
share a band are candidates, exact Jaccard similarity decides, union-find joins what is similar, and one line per component stays.
Keys of lines travel as bytes, and rows of bands packed by range, many to a row of Spark.

With 5 rows in 9 bands a pair at similarity 0.8 is missed with 2.8 % probability, at 0.9 with 0.03 %. Lines of one band are
sorted by band and line over all ranges, and each is paired with the first of the band in its range and with its neighbour, which
links the similar lines of most bands by way of each other. Bands that still hold lines of several components are then compared in
full, block by block: two lines that share a band and have close sketches are always held against each other or already linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.batches import giving_back
from sparkcast.llm.components import EDGES, Links, components, forest
from sparkcast.llm.skew import loose, unused
from sparkcast.session import cut_lineage

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 9, 5
APART = 10  # bits of 45 that the sketches of candidates may differ in; at similarity 0.8 more do with 0.40 % probability, 0.15 % where a band agrees
COVERED = 3  # lines of a band whose pairs with the first and the neighbour are all pairs
CHUNK = 1 << 16  # characters hashed at a time
SEEN = 1 << 18  # lines a task remembers to have signed
TABLE = 26  # the table of wanted lines has 2 ** 26 bits, 8 MB, for any number of lines
BLOCK, BLOCK_CHARS = 1 << 10, 1 << 18  # lines, and their characters, of a crowded band that are compared with as many others at a time
FEW = 1 << 6  # lines of a crowded band whose open pairs are judged together with those of other bands
COLUMNS = 1 << 12  # shingles counted at a time
SORTED = 1 << 19  # rows of bands that a task sorts, about
PICKED = 1 << 11  # one line in so many tells where the bands are cut into ranges
PAIRS = 1 << 10  # pairs of lines compared at a time
_EMPTY = np.uint64(0x9E3779B97F4A7C15)


def plain(line: str) -> str:
    """The form of a line that is compared; empty without a word."""
    s = line.lower()
    if s.isprintable() and "  " not in s and s[:1] != " " != s[-1:]:  # the only printable white space is the space
        return s
    return " ".join(s.split())


def _factors() -> np.ndarray:
    """Odd 32-bit factors, one for each row of the bands, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(i.to_bytes(4, "little"), 7) | 1 for i in range(BANDS * ROWS)], np.uint32)


def signatures(lines: list[str]) -> np.ndarray:
    """A row for each plain line: the 64-bit hash of the minima of every band, and a sketch of one bit of each minimum."""
    padded = [s if len(s) >= SHINGLE else s.ljust(SHINGLE, "\0") for s in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    span = len(codes) - SHINGLE + 1
    mixed = np.zeros(span, np.uint32)
    for k in range(SHINGLE):
        mixed = (mixed ^ codes[k:k + span]) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    mixed = np.append(mixed, np.uint32(0))
    ends = np.cumsum(sizes)
    cuts = np.stack([ends - sizes, ends - SHINGLE + 1], axis=1).ravel()
    keys = np.empty((len(lines), BANDS + 1), np.uint64)
    sketch = np.zeros(len(lines), np.uint64)
    factors = _factors()
    for band in range(BANDS):
        key = np.full(len(lines), _EMPTY + np.uint64(band))
        for row in range(ROWS):
            least = np.minimum.reduceat(mixed * factors[band * ROWS + row], cuts)[::2]
            key = (key ^ least) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
            sketch = sketch << np.uint64(1) | (least * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64)
        keys[:, band] = key
    keys[:, BANDS] = sketch
    return keys.view(np.int64)


def packed(rows: np.ndarray, offsets: np.ndarray | None = None) -> pa.Array:
    """The longs of every row as bytes; or, with ``offsets``, of the rows from each offset to the next."""
    if offsets is None:
        offsets = np.arange(len(rows) + 1)
    data = np.ascontiguousarray(rows)
    ends = pa.py_buffer((offsets * (8 * rows.shape[1])).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """All rows of longs of a column of ``packed`` ones, without a NULL, in order."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        first, last = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)[[0, -1]].tolist() if len(c) else (0, 0)
        if last > first:
            parts.append(np.frombuffer(c.buffers()[2], np.int64, (last - first) // 8, first))
    return np.concatenate([np.zeros(0, np.int64), *parts]).reshape(-1, width)


def _shingles(s: str) -> set[str]:
    return {s[i:i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    """Similarity of the sets of character shingles of two plain lines; a shorter line is a shingle of its own."""
    x, y = _shingles(a), _shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def are_similar(a: str, b: str, similar: float) -> bool:
    """``jaccard(a, b) >= similar``; most pairs that aren't are told by the first shingles that ``b`` lacks."""
    if len(a) >= SHINGLE <= len(b):
        missing: set[str] = set()
        most = (1 - similar) * len(a)
        for i in range(len(a) - SHINGLE + 1):
            if a[i:i + SHINGLE] not in b:
                missing.add(a[i:i + SHINGLE])
                if len(missing) > most:
                    return False
    return jaccard(a, b) >= similar


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle, repeats included, and the number of its line; shorter lines are filled up."""
    padded = [s if len(s) >= SHINGLE else s.ljust(SHINGLE, "\0") for s in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    span = len(codes) - SHINGLE + 1
    mixed, high = np.zeros(span, np.uint64), np.empty(span, np.uint64)
    for k in range(SHINGLE):
        mixed ^= codes[k:k + span]
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= np.right_shift(mixed, np.uint64(32), out=high)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(span, bool)
    inside[(starts[1:, None] - np.arange(1, SHINGLE)).ravel()] = False  # from one line into the next
    return mixed[inside], np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)


def _decided(both: np.ndarray, total: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Of counts of hashed shingles, common ones and those of two lines together: is the pair similar, and is that sure?

    Sure is what one more or one less shingle, as two of the same hash would make, doesn't change.
    """
    apart = total - both
    yes = both / apart >= similar
    return yes, np.where(yes, both - 1 >= similar * (apart + 1) + 1e-6, both + 1 < similar * (apart - 1) - 1e-6)


def _judged(texts: list[str], i: np.ndarray, j: np.ndarray, similar: float) -> np.ndarray:
    """``are_similar`` of pairs of ``texts``: shingles are counted by their hashes, many pairs at a time, and what that leaves open one by one."""
    found = np.zeros(len(i), bool)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(chars[i] + chars[j])
    low = 0
    while low < len(i):
        high = max(low + 1, min(low + PAIRS, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, "right"))))
        count = high - low
        used, at = np.unique(np.stack([i[low:high], j[low:high]], axis=1), return_inverse=True)
        hashes, owner = _hashed([texts[k] for k in used.tolist()])
        sizes = np.bincount(owner, minlength=len(used))
        at = at.ravel()
        own = sizes[at]
        tags = np.arange(2 * count, dtype=np.uint64)  # number of the pair, and which of the two
        tags = tags >> np.uint64(1) << np.uint64(54) | tags & np.uint64(1)
        keys = (hashes >> np.uint64(11) << np.uint64(1))[
            np.repeat(np.cumsum(sizes)[at] - np.cumsum(own), own) + np.arange(int(own.sum()))] | np.repeat(tags, own)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        cuts = np.append(np.searchsorted(keys, tags[::2]), len(keys))
        shared = np.nonzero(keys[1:] ^ keys[:-1] == np.uint64(1))[0]
        yes, sure = _decided(np.diff(np.searchsorted(shared, cuts)), np.diff(cuts), similar)
        for k in np.nonzero(~sure)[0].tolist():
            yes[k] = jaccard(texts[i[low + k]], texts[j[low + k]]) >= similar
        found[low:high] = yes
        low = high
    return found


def _alike(xs: list[str], ys: list[str], similar: float) -> np.ndarray:
    """``are_similar`` of ``xs`` with ``ys``, pair by pair."""
    number: dict[str, int] = {}
    i, j = (np.fromiter((number.setdefault(s, len(number)) for s in side), np.int64, len(side)) for side in (xs, ys))
    return _judged(list(number), i, j, similar)


def _numbered(text: str | None) -> Iterator[tuple[int, str, int]]:
    """Number, plain form and 64-bit hash of every line with a word."""
    for i, line in enumerate((text or "").split("\n")):
        s = plain(line)
        if s:
            h = xxhash.xxh3_64_intdigest(s.encode())
            yield i, s, h - (1 << 64) if h >> 63 else h


@giving_back
def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with its place; its band keys and sketch too, where this task hasn't met it lately."""
    names = ["doc_id", "k1", "k2", "line", "h", "bands", "picked"]
    seen: set[int] = set()

    def out(rows: list, fresh: list[int], texts: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        place = np.full(len(rows), -1)
        place[fresh] = np.arange(len(fresh))
        h = arrays[4].to_numpy()
        keys = packed(signatures(texts) if texts else np.zeros((0, BANDS + 1), np.int64))
        for mine in (place >= 0, (place >= 0) & (h % PICKED == 0)):
            arrays.append(keys.take(pa.array(place, mask=~mine)))
        return pa.RecordBatch.from_arrays(arrays, names)

    rows: list = []
    fresh: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
            for n, s, h in _numbered(text):
                if h not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    fresh.append(len(rows))
                    texts.append(s)
                    size += len(s)
                rows.append((i, k1, k2, n, h))
                if size >= CHUNK or len(rows) >= CHUNK:
                    yield out(rows, fresh, texts)
                    rows, fresh, texts, size = [], [], [], 0
    if rows:
        yield out(rows, fresh, texts)


def _cut_off(bands: np.ndarray, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The range of every row: how many of the sorted ``edges`` (band, line) aren't after it."""
    at, over = (np.searchsorted(edges[:, 0], bands, side) for side in ("left", "right"))
    inner = np.nonzero(at < over)[0]  # an edge's own band, which may go over many ranges
    for band in np.unique(bands[inner]):
        mine = inner[bands[inner] == band]
        lines = edges[at[mine[0]]:over[mine[0]], 1]
        at[mine] += np.searchsorted(lines, h[mine], "right")
    return at


def _ranges(edges):
    """Rows ``(h, bands)`` become ``(range, rows)``: rows ``(band, h, sketch)`` of one range, many as one."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(h: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            rows = np.empty((len(h), BANDS, 3), np.int64)
            rows[:, :, 0], rows[:, :, 1], rows[:, :, 2] = keys[:, :BANDS], h[:, None], keys[:, BANDS:]
            rows = rows.reshape(-1, 3)
            at = _cut_off(rows[:, 0], rows[:, 1], edges.value)
            order = np.argsort(at.astype(np.uint16) if len(edges.value) < 1 << 16 else at, kind="stable")
            at = at[order]
            starts = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
            return pa.RecordBatch.from_arrays([pa.array(at[starts]), packed(rows[order], np.append(starts, len(rows)))], ["range", "rows"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), unpacked(batch.column(1), BANDS + 1)))
            if sum(len(h) for h, _ in held) >= CHUNK:
                yield dealt(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield dealt(*map(np.concatenate, zip(*held)))

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """All rows ``(band, h, sketch)`` of a range by band and line, a part at a time."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    bands, h = columns[:2]
    order = np.argsort(bands)
    same = bands[order[1:]] == bands[order[:-1]]
    at = np.nonzero(np.append(same, False) | np.append(False, same))[0]  # most bands have one row
    order[at] = order[at][np.lexsort((h[order[at]], bands[order[at]]))]
    for i in range(0, len(order), CHUNK):
        yield [c[order[i:i + CHUNK]] for c in columns]


@giving_back
def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among ``(band, h, sketch)``, sorted here: each with the first of its band here and with the one before, if their
    sketches are close. Bands that may go on in other ranges are handed on by their first line. Distinct lines of a band that has
    more than these pairs cover, or may have with other ranges, follow without ``b``."""
    first_band = band = head = last = None
    open_bands = open_lines = np.zeros(0, np.int64)

    def members(at: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"band": at, "a": lines, "b": pa.nulls(len(at), pa.int64())})

    for bands, *row in _sorted(batches):
        n = len(bands)
        rows = np.stack(row, axis=1)
        starts = np.concatenate([[band is None or bands[0] != band], bands[1:] != bands[:-1]])
        run = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        heads = np.where((run >= 0)[:, None], rows[np.maximum(run, 0)], rows[0] if head is None else head)
        before = np.concatenate([rows[:1] if last is None else last[None], rows[:-1]])
        inner = ~starts
        a, b = np.concatenate([rows[inner], rows[inner]]), np.concatenate([heads[inner], before[inner]])
        close = (a[:, 0] != b[:, 0]) & (np.bitwise_count(a[:, 1].view(np.uint64) ^ b[:, 1].view(np.uint64)) <= APART)
        found = np.unique(np.sort(np.stack([a[close, 0], b[close, 0]], axis=1), axis=1), axis=0)
        if first_band is None:
            first_band = bands[0]
            yield pa.RecordBatch.from_pydict({"band": bands[:1], "a": rows[:1, 0], "b": rows[:1, 0]})
        yield pa.RecordBatch.from_pydict({"band": np.zeros(len(found), np.int64), "a": found[:, 1], "b": found[:, 0]})
        fresh = starts | (rows[:, 0] != before[:, 0])
        fresh[0] |= last is None
        open_bands, open_lines = np.concatenate([open_bands, bands[fresh]]), np.concatenate([open_lines, rows[fresh, 0]])
        ended = open_bands != bands[-1]
        _, at, sizes = np.unique(open_bands[ended], return_inverse=True, return_counts=True)
        many = (sizes[at] > COVERED) | (open_bands[ended] == first_band)
        yield members(open_bands[ended][many], open_lines[ended][many])
        open_bands, open_lines = open_bands[~ended], open_lines[~ended]
        band, head, last = bands[-1], heads[-1], rows[-1]
    yield members(open_bands, open_lines)
    if band is not None and band != first_band:
        yield pa.RecordBatch.from_pydict({"band": [int(band)], "a": [int(head[0])], "b": [int(head[0])]})


def _range_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_pairs`` of the rows of a range."""
    rows = (unpacked(batch.column("rows"), 3) for batch in batches)
    return _pairs(pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["band", "h", "sketch"]) for part in rows)


def edges_of(picked: DataFrame, count: int) -> np.ndarray:
    """``(band, line)``, sorted, that cut the rows of all bands into ``count`` ranges of about the same size, by the few lines ``picked``."""
    found = picked.toArrow()
    keys = unpacked(found.column(1), BANDS + 1)[:, :BANDS]
    h = np.repeat(found.column(0).to_numpy(), BANDS)
    keys = keys.ravel()
    order = np.lexsort((h, keys))
    rows = np.stack([keys[order], h[order]], axis=1)
    at = np.arange(1, count) * len(rows) // count
    return rows[np.unique(at[at > 0])]


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, a > b: distinct pairs of lines that share a band; and ``(band, h)``: the lines of bands that have more pairs.

    ``signed`` has ``h`` and ``bands`` (NULL: signed elsewhere), and ``picked``, the ``bands`` of a few lines.
    """
    spark = signed.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() * BANDS // SORTED))
    edges = spark.sparkContext.broadcast(edges_of(signed.where("picked IS NOT NULL").select("h", "picked"), count))
    packs = signed.where("bands IS NOT NULL").select("h", "bands").mapInArrow(_ranges(edges), "range long, rows binary")
    found = cut_lineage(packs.repartitionById(count, F.col("range").cast("int")).mapInArrow(_range_pairs, "band long, a long, b long"))
    ends = found.where("a = b")
    heads = ends.groupBy("band").agg(F.min("a").alias("head"))
    across = ends.join(heads, "band").where("a > head").select("a", F.col("head").alias("b"))
    pairs = found.where("a > b").select("a", "b").unionByName(across).distinct()
    members = found.where("b IS NULL").select("band", F.col("a").alias("h"))
    large = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= COVERED)
    return pairs, members.join(loose(large), "band").select("band", "h")


def _overlaps(texts: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common hashed shingles of every line of ``left`` with every one of ``right``, and those of each text."""
    hashes, owner = _hashed(texts)
    bits = np.uint64(len(texts).bit_length())
    keys = hashes >> bits << bits | owner.astype(np.uint64)  # one plain sort of hash and text
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    owner, hashes = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), keys >> bits
    ids = np.cumsum(np.concatenate([[False], hashes[1:] != hashes[:-1]]))
    columns = int(ids[-1]) + 1
    sizes = np.bincount(owner, minlength=len(texts))
    shared = np.bincount(ids, minlength=columns) > 1
    ids, owner, columns = (np.cumsum(shared) - 1)[ids[shared[ids]]], owner[shared[ids]], int(shared.sum())
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, columns, COLUMNS):
        part = slice(*np.searchsorted(ids, [start, start + COLUMNS]))
        has = np.zeros((len(texts), min(COLUMNS, columns - start)), np.float32)
        has[owner[part], ids[part] - start] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    return both, sizes


def _near(rows: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar lines of different components, one of block ``lo`` and one of ``hi``, that share no earlier band and have close sketches."""
    band, lo, hi = (rows.column(n)[0].as_py() for n in ("band", "lo", "hi"))
    block, h, c = (rows.column(n).to_numpy() for n in ("block", "h", "c"))
    keys = unpacked(rows.column("keys"), BANDS + 1)
    left, right = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
    sketch = keys[:, BANDS].astype(np.uint64)
    open_ = (c[left][:, None] != c[right]) & (np.bitwise_count(sketch[left][:, None] ^ sketch[right]) <= APART)
    if lo == hi:
        open_ &= left[:, None] < right
    for k in range(int(np.nonzero(keys[0, :BANDS] == band)[0][0])):
        open_ &= keys[left, k][:, None] != keys[right, k]
    x, y = open_.any(axis=1), open_.any(axis=0)
    left, right, open_ = left[x], right[y], open_[x][:, y]
    if not len(left):
        return left, right
    used, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    texts = rows.column("line").take(pa.array(used)).to_pylist()
    both, sizes = _overlaps(texts, at[:len(left)], at[len(left):])
    yes, sure = _decided(both, sizes[at[:len(left)]][:, None] + sizes[at[len(left):]], similar)
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(open_ & ~sure))):
        yes[i, j] = jaccard(texts[at[i]], texts[at[len(left) + j]]) >= similar
    i, j = np.nonzero(open_ & yes)
    return h[left[i]], h[right[j]]


def _near_in_small(rows: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """``_near`` for many whole bands of few lines, one after the other, at a time."""
    band, h, c = (rows.column(n).to_numpy() for n in ("band", "h", "c"))
    keys = unpacked(rows.column("keys"), BANDS + 1)
    ends = np.append(np.nonzero(band[1:] != band[:-1])[0] + 1, len(band))
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(band)) - 1  # lines of the band after a line
    i = np.repeat(np.arange(len(band)), later)
    j = i + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later) + 1
    open_ = (c[i] != c[j]) & (np.bitwise_count((keys[i, BANDS] ^ keys[j, BANDS]).view(np.uint64)) <= APART)
    i, j = i[open_], j[open_]
    first = (keys[i, :BANDS] == keys[j, :BANDS]).argmax(axis=1)
    mine = keys[i, first] == band[i]
    i, j = i[mine], j[mine]
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    yes = _judged(rows.column("line").take(pa.array(used)).to_pylist(), at[:len(i)], at[len(i):], similar)
    return h[i[yes]], h[j[yes]]


def _compare_blocks(similar: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("band").to_numpy(), kind="stable")))
        texts = rows.column("line").to_pylist()
        keys = np.concatenate([signatures(texts[i:i + 256]) for i in range(0, len(texts), 256)])
        rows = rows.append_column("keys", packed(keys))
        _, at, sizes = np.unique(rows.column("band").to_numpy(), return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes)
        small = (sizes <= FEW) & (rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py())
        found = [_near_in_small(rows.filter(pa.array(small[at])), similar)]
        found += [_near(rows.slice(ends[k] - sizes[k], sizes[k]), similar) for k in np.nonzero(~small)[0].tolist()]
        a, b = forest(*map(np.concatenate, zip(*found)))
        return pa.table({"a": a, "b": b})

    return run


def left_over(crowds: DataFrame, texts: DataFrame, roots: DataFrame, similar: float) -> DataFrame | None:
    """Links between lines that share a band and that ``roots`` (``node``, ``component``) doesn't join; None without such a band.

    ``texts`` has ``h``, ``line`` and ``chars``, the length of the line; hardly any that is in no such band is shuffled. Lines of a band are dealt into blocks, and each pair of blocks is a group of its own; bands of one block are grouped
    by many. A pair of lines that shares several bands is compared in the first.
    """
    placed = crowds.join(loose(roots.toDF("h", "c")), "h", "left").select("band", "h", F.coalesce("c", "h").alias("c"))
    placed = cut_lineage(placed)
    several = placed.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    placed = cut_lineage(placed.join(loose(several.select("band")), "band")
                         .join(texts.select("h", "chars"), "h"))
    if placed.isEmpty():
        return None
    sizes = placed.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS)).alias("blocks"))
    groups = placed.agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS))).first()[0]
    sizes = sizes.withColumn("group", F.when(F.col("blocks") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(groups))))
    dealt = placed.join(loose(sizes), "band").withColumn("block", F.pmod(F.xxhash64("h"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = _held(placed.sparkSession.sparkContext.broadcast(wanted_table(placed.select("h").distinct())))
    rows = dealt.join(texts.where(held("h")).drop("chars"), "h").select(
        "group", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "h", "c", "line")
    return rows.groupBy("group", "lo", "hi").applyInArrow(_compare_blocks(similar), EDGES)


def _similar(similar: float):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _alike(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similar)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the table."""
    u = h.view(np.uint64)
    mask = np.uint64((1 << TABLE) - 1)
    return u & mask, (u >> np.uint64(TABLE)) & mask


def _set_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    first, second = (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) for at in _bits(h))
    return (first & second).astype(bool)


def wanted_table(wanted: DataFrame) -> np.ndarray:
    """A table of bits, of one size whatever it holds, that is set for every ``h``: most other lines needn't be shuffled."""
    mask = (1 << TABLE) - 1
    places = wanted.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", TABLE).bitwiseAND(mask))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << TABLE - 6, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _line_texts(table):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        sent: set[int] = set()
        for batch in batches:
            found: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                for _, s, h in _numbered(text):
                    found[h] = s
            h = np.fromiter(found, np.int64, len(found))
            if len(sent) >= SEEN:
                sent.clear()
            kept = [x for x in h[_set_in(bits, h)].tolist() if x not in sent]
            sent.update(kept)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([found[x] for x in kept], pa.string())], ["h", "line"])

    return run


def linked_lines(docs: DataFrame, signed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(node, component)`` of the lines that are similar to others; ``docs`` has ``text``."""
    pairs, crowds = map(cut_lineage, candidates(signed))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(crowds.select("h")).distinct()
    table = docs.sparkSession.sparkContext.broadcast(wanted_table(wanted))
    texts = (docs.select("text").mapInArrow(_line_texts(table), "h long, line string").join(loose(wanted), "h", "left_semi")
             .groupBy("h").agg(F.first("line").alias("line")))
    texts = cut_lineage(texts.withColumn("chars", F.length("line")))
    left, right = (texts.select(F.col("h").alias(h), F.col("line").alias(line)) for h, line in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    roots = components(both.mapInArrow(_similar(similar), EDGES))
    more = left_over(crowds, texts, roots, similar)
    return roots if more is None else components(roots.toDF("a", "b").unionByName(more))


def duplicate_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(k1, k2, gone)``: for each document that loses lines, their numbers from 0. ``docs`` has ``doc_id, text, k1, k2``."""
    signed = cut_lineage(docs.select("doc_id", "k1", "k2", "text").mapInArrow(
        _line_rows, "doc_id long, k1 long, k2 long, line int, h long, bands binary, picked binary"))
    roots = linked_lines(docs, signed, similar).select(F.col("node").alias("h"), "component")
    lines = signed.select("doc_id", "k1", "k2", "line", "h").join(loose(roots), "h", "left")
    lines = lines.select(F.coalesce("component", "h").alias("c"), F.struct(
        F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2", "line").alias("place"))
    stays = lines.groupBy("c").agg(F.min("place").alias("stays"), F.count("*").alias("n")).where("n > 1").select("c", "stays")
    gone = lines.join(loose(stays), "c").where("place > stays").select("place.k1", "place.k2", "place.line").distinct()
    return gone.groupBy("k1", "k2").agg(F.collect_list("line").alias("gone"))


def keyed(docs: DataFrame, k1: str, k2: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns ``k1`` and ``k2`` for what makes a document: its id and its text."""
    return docs.withColumns({k1: F.xxhash64(text, doc_id), k2: F.xxhash64(F.lit(1), doc_id, text)})


def _held(table):
    """Are keys in a broadcast table of bits? A few that were not put there are, too."""
    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        return pa.array(_set_in(table.value, keys.to_numpy(zero_copy_only=False)))

    return held


def _without(text: int, gone: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(text).to_pylist(), batch.column(gone).to_pylist()
            for i, numbers in enumerate(lost):
                if numbers:
                    drop = set(numbers)
                    texts[i] = "\n".join(s for n, s in enumerate(texts[i].split("\n")) if n not in drop)
            columns = list(batch.columns)
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def without_duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with all columns and, as the last, ``_gone``: the numbers of the lines taken from ``text``; every row stays.

    Where ``docs`` has a column of that name, the new one gets underscores at its end.

    Of the lines of the whole corpus that are equal or similar, directly or by way of others, the first stays: the one with the
    smallest document id (NULL last), then the smallest key of the text, then the first line. Lines without a word stay. A text that loses
    all its lines becomes empty, NULL texts stay NULL. Rows equal in id and text are one document and get the same
    result. An empty table gives an empty result. Runs jobs when called. Documents that lose nothing are not shuffled, up to a few.
    """
    k1, k2, gone = (unused(docs, name) for name in ("_k1", "_k2", "_gone"))
    with_keys = keyed(docs, k1, k2, doc_id, text)
    base = with_keys.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"),
                            F.col(text).alias("text"))
    lost = cut_lineage(duplicate_lines(base, similar).toDF(k1, k2, gone))
    held = _held(docs.sparkSession.sparkContext.broadcast(wanted_table(lost.select(F.col(k1).alias("h")))))
    joined = with_keys.where(held(k1)).join(loose(lost), [k1, k2], "left").select(*docs.columns, gone)
    shorter = joined.mapInArrow(_without(docs.columns.index(text), len(docs.columns)), joined.schema)
    return shorter.union(with_keys.where(~held(k1)).select(*docs.columns, F.lit(None).cast(joined.schema[gone].dataType).alias(gone)))
