"""Joins in which one key may hold a large part of the rows, and names for columns beside those of a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame


def loose(small: DataFrame) -> DataFrame:
    """``small`` dealt by all its columns: a join on some of them then deals both sides, and Spark splits hot keys of the other.

    A side that comes straight from an aggregation by the key would keep its partitions, and the other side's hot keys theirs.
    """
    return small.repartition(*small.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
