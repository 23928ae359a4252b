"""Equality joins that stay even: a side is broadcast only after its rows were counted, and keys that many rows have are joined apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, at most. Beyond it, only its rows for hot keys are, which are fewer than this.
BROADCAST_ROWS = 100_000


def is_small(side: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a side has at most ``most`` rows; no more than these are counted."""
    return side.limit(most + 1).count() <= most


def hot_bound(n_rows: int, most: int = BROADCAST_ROWS) -> int:
    """Rows of a key beyond which it is hot: fewer than ``most`` keys can have so many."""
    return max(1_000, n_rows // most)


def join_even(rows: DataFrame, side: DataFrame, key: str, most: int = BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """Inner join with a side that has few rows of each key.

    A small side is broadcast. Else keys of more than ``bound`` rows meet their part of the side by a broadcast, so that
    none fills a task, and all others meet theirs by a shuffle; each way gives the same rows.
    """
    if is_small(side, most):
        return rows.join(F.broadcast(side), key)
    n = rows.groupBy(key).count()
    if bound is None:
        bound = hot_bound(n.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], most)
    hot = n.where(F.col("count") > bound).select(key)
    few = rows.join(F.broadcast(hot), key, "left_anti").join(side, key)
    return rows.join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key).unionByName(few)
