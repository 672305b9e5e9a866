"""Connected components of a table of links, kept as distributed forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.skew import loose
from sparkcast.session import cut_lineage

HELD = 1 << 20  # links a task holds before it contracts them
EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (a, b): every node that isn't its component's smallest, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


class Links:
    """Links found by a task, handed on as forests of bounded size."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.parts.append((a, b))
            self.size += len(a)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            node, root = forest(*(np.concatenate(p) for p in zip(*self.parts)))
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_pydict({"a": node, "b": root})


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a task."""
    links = Links()
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield from links.add(a, b)
    yield from links.flush()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = loose(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = loose(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that has a link and isn't itself the smallest of its component.

    ``links`` has two long columns. Each task contracts the links it holds by union-find; the forests are then united by rounds
    of large and small stars, each written to the shared folder, until every node hangs from its component's smallest one.
    A node with very many links is no group anywhere: minima are aggregated and joined back. NULL ends and loops are no links.
    An empty table gives an empty result. Runs jobs when called.
    """
    a, b = links.columns
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    down = known.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a > b")
    now = cut_lineage(down.mapInArrow(contract, EDGES).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        now = cut_lineage(_small_star(_large_star(now)))
