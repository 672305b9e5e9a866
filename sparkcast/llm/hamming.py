"""Exact nearest neighbours of binary codes by multi-index hashing.

The rows are dealt into shards, the queries into blocks, and a task searches a shard for a block. There a code has 64 bits in ``m`` segments
of about as many bits as a number for each code needs. The radius of one segment after the other grows by a bit. When those
before segment ``j`` have been searched up to ``s`` bits, and the others up to ``s - 1``, a code that wasn't met differs in at
least ``m s + j`` bits: a query whose k-th verified distance is less than that is answered and leaves.

Shards are searched in rounds, each with several times as many as all before. A query brings its k-th distance so far, so that a
round hands on about as many rows for it as the one before, and not ``k`` of every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcast.session import cut_lineage

BITS = 64
FEWEST, MANY = 4, 8  # segments
SHARD = 1 << 16  # rows of a shard, about
LEAST, BLOCK = 64, 1 << 13  # distinct queries of a block, about
GROWS = 4  # shards searched after a round, for each before it
PAIRS = 4  # pairs of a shard and a block that a task searches
HELD = 1 << 20  # probes or rows looked at at a time


def sign_code(vector: Column) -> Column:
    """The signs of a vector of at most 64 numbers: bit i is set where number i is above 0 (NULL and NaN are not)."""
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    folded = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error("a code has at most 64 bits")).otherwise(folded)


def borders(codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment, for as many distinct codes."""
    m = min(MANY, max(FEWEST, round(BITS / max(1.0, math.log2(max(codes, 2))))))
    ends = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _masks(width: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), weight)], np.int64)


def _cut(codes: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    """A segment of each code."""
    return (codes.view(np.uint64) >> np.uint64(at[0]) & np.uint64((1 << at[1]) - 1)).astype(np.int64)


class Shard:
    """The rows of a shard, by the value of each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray) -> None:
        self.parts = borders(len(np.unique(codes)))
        self.ids, self.codes, self.orders, self.starts = ids, codes, [], []
        for at in self.parts:
            value = _cut(codes, at)
            self.orders.append(np.argsort(value, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << at[1]))]))

    def _met(self, queries: np.ndarray, j: int, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and rows whose segments ``j`` differ in exactly ``s`` bits, some queries at a time."""
        masks, value = _masks(self.parts[j][1], s), _cut(queries, self.parts[j])
        for first in range(0, len(queries), step := max(1, HELD // len(masks))):
            probes = value[first:first + step, None] ^ masks
            begin = self.starts[j][probes]
            sizes = self.starts[j][probes + 1] - begin
            ends = np.cumsum(sizes.sum(axis=1))
            low = 0
            while low < len(ends):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HELD, "right")))
                n, at = sizes[low:high].ravel(), begin[low:high].ravel()
                place = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
                yield np.repeat(np.arange(first + low, first + high), sizes[low:high].sum(axis=1)), self.orders[j][place]
                low = high

    def _round(self, queries: np.ndarray, bound: np.ndarray, j: int, s: int) -> Iterator[np.ndarray]:
        """``(query, distance, row)``, no farther than ``bound``, that no earlier round has met."""
        for q, row in self._met(queries, j, s):
            apart = queries[q] ^ self.codes[row]
            distance = np.bitwise_count(apart.view(np.uint64)).astype(np.int64)
            near = distance <= bound[q]
            q, row, apart, distance = q[near], row[near], apart[near], distance[near]
            first = np.min([np.bitwise_count(_cut(apart, at)).astype(np.int64) * len(self.parts) + i for i, at in enumerate(self.parts)], axis=0)
            new = first == s * len(self.parts) + j
            yield np.stack([q[new], distance[new], row[new]])

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the queries, distances and ids of the ``k`` rows nearest to each, no farther than ``bound``."""
        best, bound, active = np.zeros((3, 0), np.int64), bound.copy(), np.arange(len(queries))
        m = len(self.parts)
        for s, j in product(range(max(width for _, width in self.parts) + 1), range(m)):
            if s > self.parts[j][1]:
                continue
            for found in self._round(queries[active], bound[active], j, s):
                found[0] = active[found[0]]
                best = np.concatenate([best, found], axis=1)
                best = best[:, np.lexsort((self.ids[best[2]], best[1], best[0]))]
                starts = np.searchsorted(best[0], best[0])
                best = best[:, np.arange(best.shape[1]) - starts < k]
                whole = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) == k - 1]
                bound[whole[0]] = np.minimum(bound[whole[0]], whole[1])
            active = active[bound[active] > s * m + j]
            if not len(active):
                break
        return best[0], best[1], self.ids[best[2]]


def _packed(rows: pa.Table) -> pa.Table:
    """One row for a shard or a block: its number and its two columns as packed longs."""
    number, *columns = rows.columns
    packed = np.stack([c.to_numpy() for c in columns])
    return pa.table({"number": number[:1], "packed": pa.array([packed.tobytes()], pa.binary())})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(*(batch.column(c) for c in ("rows", "asked"))):
                ids, codes = np.frombuffer(rows.as_buffer(), np.int64).reshape(2, -1)
                queries, bound = np.frombuffer(asked.as_buffer(), np.int64).reshape(2, -1)
                q, distance, found = Shard(ids, codes).search(queries, bound, k)
                yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(distance, pa.int32()), pa.array(found)], ["query", "distance", "id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "distance", "id")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``(number, packed)``: the rows, two longs each, dealt by a hash of the code, the second or first of them."""
    code = "code" if "code" in rows.columns else "query"
    numbered = rows.select(F.pmod(F.xxhash64(code), F.lit(parts)).cast("long").alias("number"), *(F.col(c).cast("long") for c in rows.columns))
    return numbered.groupBy("number").applyInArrow(_packed, "number long, packed binary")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", query_id: str = "vec_id",
            code: str = "code") -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` rows nearest to each query, by distance and then id.

    Both frames have an id and a long ``code``. A query that is itself a row finds itself. Rows or queries with a NULL id or code
    take no part, repeated ones count once; with fewer than ``k`` rows all are returned; an empty table gives an empty result.
    Equal codes are searched once, and of the rows that share one only the ``k`` smallest ids can be answers. Runs jobs.
    """
    known = rows.select(F.col(row_id).cast("long").alias("id"), F.col(code).alias("code")).where("id IS NOT NULL AND code IS NOT NULL").distinct()
    place = F.row_number().over(W.partitionBy("code").orderBy("id"))
    index = cut_lineage(known.withColumn("place", place).where(F.col("place") <= k).select("id", "code"))
    asked = cut_lineage(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(code).alias("query"))
                        .where("query_id IS NOT NULL AND query IS NOT NULL").distinct())
    distinct = asked.select("query").distinct()
    many, wanted = index.count(), distinct.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-many // SHARD))
    blocks = max(1, -(-wanted // BLOCK), min(-(-tasks // shards), -(-wanted // LEAST)))
    held = cut_lineage(_dealt(index, shards))
    best, first = None, 0
    while best is None or first < shards:
        last = min(shards, max(1, GROWS * first))
        bound = F.lit(BITS)
        active = distinct
        if best is not None:
            kth = best.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("kth"))
            active, bound = distinct.join(kth, "query", "left"), F.coalesce("kth", F.lit(BITS))
        met = held.where(F.col("number").between(first, last - 1)).select(F.col("number").alias("shard"))
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = (met.join(held.toDF("shard", "rows"), "shard").join(_dealt(active.select("query", bound.alias("bound")), blocks).toDF("block", "asked"), "block")
                 .repartition(max(tasks, (last - first) * blocks // PAIRS), "shard", "block").select("rows", "asked"))
        found = pairs.mapInArrow(_search(k), "query long, distance int, id long")
        best = cut_lineage(_best(found if best is None else found.unionByName(best), k))
        first = last
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id")).alias("rank")
    return asked.join(best.select("*", rank), "query").select("query_id", "id", "distance", "rank")
