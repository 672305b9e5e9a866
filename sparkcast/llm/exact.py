"""Exact duplicates by an index of cuckoo filters over live digests.

A text, A-Z in lower case, has a 64-bit key and a SHA-256. The index is dealt into shards by the key. A shard is a cuckoo filter of the keys that
live in it and the stored entries they come from: key, SHA-256, the row that stays, the number of rows. An arriving digest that the
filter doesn't know is new and goes in; a hit is held against the stored entries, where it joins its equal or turns out to be a false
one and goes in too. A filter that overflows is built anew, twice as large, from the stored keys. Digests leave by deletion of one
fingerprint each. The texts of all hits are then fetched, bucketed by digest and compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm import bits
from sparkcast.llm.skew import loose
from sparkcast.session import cut_lineage

SLOTS = 4
KICKS = 256
SHARD = 1 << 17  # digests of a shard, about
STEP = 1 << 13  # arrivals that one look into the filter answers
CACHED = 1 << 24  # bytes of texts a task keeps, to send equal ones once
ENTRY = "shard long, key long, sha binary, doc_id long, rid long, n long, filter binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key may lie in either of two buckets. Keys come in numpy arrays of unsigned longs."""

    def __init__(self, buckets: int = 1 << 8, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return prints, ((mixed ^ mixed >> np.uint64(32)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = (prints.astype(np.uint32) * np.uint32(0x85EBCA6B) >> np.uint32(7)).astype(np.int64) | 1
        return at ^ (apart & len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._places(keys)
        found = self.table[at] == prints[:, None]
        found |= self.table[self._other(prints, at)] == prints[:, None]
        return found.any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Put the keys in. False: some found no place, and the filter must be built anew."""
        prints, at = self._places(keys)
        for kick in range(KICKS):
            if not len(prints):
                return True
            here, first = np.unique(at, return_index=True)  # one for each bucket; the others wait
            free = self.table[here] == 0
            slot = np.where(free.any(axis=1), free.argmax(axis=1), (prints[first] + kick) % SLOTS)
            out = self.table[here, slot]
            self.table[here, slot] = prints[first]
            waits = np.ones(len(prints), bool)
            waits[first] = False
            full = np.nonzero(waits)[0]
            rest_at = np.where(kick & 1, self._other(prints[full], at[full]), at[full])
            moved = out != 0
            prints, at = np.concatenate([out[moved], prints[full]]), np.concatenate([self._other(out[moved], here[moved]), rest_at])
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        """Take one fingerprint of each key out; every key must be in the filter, as often as it is given."""
        prints, at = self._places(keys)
        other = self._other(prints, at)
        while len(prints):
            _, first = np.unique(np.minimum(at, other), return_index=True)
            p, here = prints[first], at[first]
            there = ~(self.table[here] == p[:, None]).any(axis=1)
            here = np.where(there, other[first], here)
            self.table[here, (self.table[here] == p[:, None]).argmax(axis=1)] = 0
            rest = np.ones(len(prints), bool)
            rest[first] = False
            prints, at, other = prints[rest], at[rest], other[rest]


class Shard:
    """The filter and the stored entries of a shard."""

    def __init__(self, stored: pa.Table) -> None:
        entries = stored.filter(pc.is_valid(stored["key"]))
        self.keys, self.shas, self.ids, self.rids, self.sizes = (
            entries[c].to_pylist() for c in ("key", "sha", "doc_id", "rid", "n"))
        self.slots: dict[int, list[int]] = {}
        for slot, key in enumerate(self.keys):
            self.slots.setdefault(key, []).append(slot)
        blobs = [b for b in stored["filter"].to_pylist() if b is not None]
        self.filter = CuckooFilter(table=np.frombuffer(blobs[0], np.uint16).reshape(-1, SLOTS).copy()) if blobs else CuckooFilter()

    def _slot(self, key: int, sha: bytes) -> int | None:
        return next((s for s in self.slots.get(key, ()) if self.shas[s] == sha), None)

    def _grow(self) -> None:
        buckets, live = 2 * len(self.filter.table), np.array([k for k, s in self.slots.items() if s], np.int64).view(np.uint64)
        self.filter = CuckooFilter(buckets)
        while not self.filter.insert(live):
            buckets *= 2
            self.filter = CuckooFilter(buckets)

    def _looked_up(self, arrivals: pa.Table) -> Iterator[tuple[list, np.ndarray]]:
        for start in range(0, arrivals.num_rows, STEP):
            part = arrivals.slice(start, STEP)
            hit = self.filter.contains(part["key"].to_numpy().view(np.uint64))
            yield list(zip(*(part[c].to_pylist() for c in ("key", "sha", "doc_id", "rid", "n")))), hit

    def insert(self, arrivals: pa.Table) -> None:
        for rows, hit in self._looked_up(arrivals):
            fresh: set[int] = set()
            for (key, sha, doc, rid, n), known in zip(rows, hit.tolist()):
                slot = self._slot(key, sha) if known or key in fresh else None
                if slot is None:
                    if not self.slots.get(key):
                        fresh.add(key)
                    self.slots.setdefault(key, []).append(len(self.keys))
                    for column, value in zip((self.keys, self.shas, self.ids, self.rids, self.sizes), (key, sha, doc, rid, n)):
                        column.append(value)
                else:
                    self.sizes[slot] += n
                    if (doc is not None, doc or 0, rid) > (self.ids[slot] is not None, self.ids[slot] or 0, self.rids[slot]):
                        self.ids[slot], self.rids[slot] = doc, rid
            if fresh and not self.filter.insert(np.array(sorted(fresh), np.int64).view(np.uint64)):
                self._grow()

    def delete(self, leaving: pa.Table) -> None:
        gone = []
        for rows, hit in self._looked_up(leaving):
            for (key, sha, *_), known in zip(rows, hit.tolist()):
                slot = self._slot(key, sha) if known else None
                if slot is not None:
                    self.slots[key].remove(slot)
                    self.keys[slot] = None
                    if not self.slots[key]:
                        gone.append(key)
        self.filter.delete(np.array(gone, np.int64).view(np.uint64))

    def table(self, shard: int) -> pa.Table:
        live = [s for s, k in enumerate(self.keys) if k is not None]
        of = lambda column: [column[s] for s in live] + [None]
        schema = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("doc_id", pa.int64()),
                            ("rid", pa.int64()), ("n", pa.int64()), ("filter", pa.binary())])
        columns = [[shard] * (len(live) + 1), *map(of, (self.keys, self.shas, self.ids, self.rids, self.sizes)),
                   [None] * len(live) + [self.filter.table.tobytes()]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def normal(text: str | None) -> bytes:
    """What is compared: the UTF-8 bytes with A-Z in lower case; NULL counts as empty."""
    return (text or "").encode().lower()


def digest(data: bytes) -> tuple[int, bytes]:
    """The signed key and the SHA-256 of a normal text."""
    key = xxhash.xxh3_64_intdigest(data)
    return key - (1 << 64) if key >> 63 else key, hashlib.sha256(data).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digest(normal(t.as_py())) for t in batch.column(1)]
        keys, shas = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(shas, pa.binary())], ["doc_id", "key", "sha"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, key, sha, rid)`` of every row, written to the shared folder; ``rid`` is a number of its own for each row."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cut_lineage(read.mapInArrow(_digests, "doc_id long, key long, sha binary").withColumn("rid", F.monotonically_increasing_id()))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a batch as one arrival, with the row that has the largest id (NULL is the smallest) and their number."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("rid", "ascending")], null_placement="at_start")
        found = rows.take(order).group_by(["key", "sha"], use_threads=False).aggregate(
            [("doc_id", "last"), ("rid", "last"), ("rid", "count")])
        # "last" passes over NULLs: an id that is there is also the larger one
        yield from found.select(["key", "sha", "doc_id_last", "rid_last", "rid_count"]).rename_columns(
            ["key", "sha", "doc_id", "rid", "n"]).to_batches()


@dataclass
class Index:
    """A written index: a row for every live digest, and one for each shard with its filter."""

    shards: int
    table: DataFrame

    @property
    def entries(self) -> DataFrame:
        return self.table.where("key IS NOT NULL").select("key", "sha", "doc_id", "rid", "n")


def empty_index(known: DataFrame) -> Index:
    """An index for about as many digests as ``known`` has rows."""
    spark = known.sparkSession
    return Index(max(1, -(-known.count() // SHARD)), spark.createDataFrame([], ENTRY))


def _passed(index: Index, known: DataFrame, act: str) -> Index:
    def run(arrivals: pa.Table, stored: pa.Table) -> pa.Table:
        shard = Shard(stored)
        getattr(shard, act)(arrivals)
        return shard.table((arrivals if arrivals.num_rows else stored)["shard"][0].as_py())

    rows = known.mapInArrow(_collapse, "key long, sha binary, doc_id long, rid long, n long")
    rows = rows.withColumn("shard", F.pmod("key", F.lit(index.shards)))
    done = rows.groupBy("shard").cogroup(index.table.groupBy("shard")).applyInArrow(run, ENTRY)
    return Index(index.shards, cut_lineage(done))


def insert(index: Index, known: DataFrame) -> Index:
    """The index with the rows of ``known`` (see ``digests``) in it; digests that it holds get them added to their number."""
    return _passed(index, known, "insert")


def delete(index: Index, known: DataFrame) -> Index:
    """The index without the digests of ``known``, whatever rows they stand for; digests that it doesn't hold are passed over."""
    return _passed(index, known, "delete")


def _hit_texts(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, bytes] = {}
        size = 0
        for batch in batches:
            texts = [normal(t.as_py()) for t in batch.column(0)]
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
            rows = []
            for at in np.nonzero(bits.held(table.value, keys))[0].tolist():
                data = texts[at]
                key, sha = digest(data)
                if sent.get(sha) == data:
                    continue
                rows.append((key, sha, data))
                if size + len(data) > CACHED:
                    sent, size = {}, 0
                sent[sha], size = data, size + len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                                                 ["key", "sha", "content"])

    return run


def verify(docs: DataFrame, hits: DataFrame, text: str = "text") -> None:
    """Compare the texts of all ``hits`` (``key, sha``), byte by byte; an error says that two texts of one digest differ.

    Each task sends an equal text once; of a digest one text is the bucket's content, and all others of it are held against that.
    """
    found = cut_lineage(hits.select("key", "sha"))
    count = found.count()
    if not count:
        return
    table = docs.sparkSession.sparkContext.broadcast(bits.build(found.select("key"), count))
    texts = docs.select(F.col(text).cast("string")).mapInArrow(_hit_texts(table), "key long, sha binary, content binary")
    contents = cut_lineage(texts.join(loose(found), ["key", "sha"], "left_semi"))
    buckets = contents.groupBy("key", "sha").agg(F.first("content").alias("live"))
    if not contents.join(loose(buckets.select("key", "sha", "live")), ["key", "sha"]).where("content != live").isEmpty():
        raise ValueError("two different texts share a SHA-256")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, sha)`` for every row of ``docs``; other columns are not read.

    Texts are equal when they are after A-Z went to lower case; NULL counts as empty. Of equal texts the row with the largest id is
    kept, of rows equal in id, too, one of them. NULL ids are the smallest: ``keep_id`` is NULL only where all of a group are. An empty table
    gives an empty result. Runs jobs when called.
    """
    known = digests(docs, doc_id, text)
    index = insert(empty_index(known), known)
    hits = cut_lineage(index.entries.where("n > 1"))
    verify(docs, hits, text)
    groups = loose(hits.select("key", "sha", F.col("doc_id").alias("keep_id"), F.col("rid").alias("stays"), F.col("n").alias("size")))
    rows = known.join(groups, ["key", "sha"], "left")
    alone = F.col("size").isNull()
    return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                       F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                       (alone | (F.col("rid") == F.col("stays"))).alias("kept"), "sha")
