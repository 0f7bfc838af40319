"""Joins of a table with a small row for each of its keys, where a few keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most: each has more than this share of all rows.
MOST_HEAVY = 2000


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], total: int, times: str = "times") -> DataFrame:
    """rows joined to found by keys. found: one row a key, with ``times``, in how many of the ``total`` rows it occurs.

    Keys of more than total / MOST_HEAVY rows, fewer than MOST_HEAVY by that, are broadcast, and their rows stay where they
    are; only the rows of other keys are shuffled. rows should be cheap to read twice.
    """
    limit = max(1000, total // MOST_HEAVY)
    heavy = found.where(F.col(times) > limit)
    if total <= limit or heavy.isEmpty():
        return rows.join(found.drop(times), keys)
    here = rows.join(F.broadcast(heavy.drop(times)), keys)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return here.unionByName(others.join(found.where(F.col(times) <= limit).drop(times), keys))
