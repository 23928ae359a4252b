"""Running sums and last values over ordered rows, where one key may have any part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks into which the order is cut.
BLOCKS = 4096


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with, per key and by ``order`` (a number), the sum so far of each of ``sums`` and the last value so far that isn't null of each of ``lasts``.

    The row itself counts unless ``before``; sums of nothing are 0 and last values null. The order is cut into blocks: each
    is folded first, the folds of a key are run through, and rows are sorted within their block of their key alone. So
    no task sorts more than a block and no window passes over all rows of a key. Rows of a key must not share a place.
    """
    sums, lasts = sums or {}, lasts or {}
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, high = (0, 0) if low is None else (low, high)
    block = F.floor((F.col(order) - F.lit(low)) / F.lit((high - low) // blocks + 1))
    rows = rows.withColumns({f"__{n}": c for n, c in {**sums, **lasts}.items()} | {"__block": block})
    folded = rows.groupBy(*keys, "__block").agg(
        *(F.sum(f"__{n}").alias(f"__b_{n}") for n in sums), *(F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__b_{n}") for n in lasts), F.count("*").alias("__rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(*keys, "__block", *(F.sum(f"__b_{n}").over(earlier).alias(f"__c_{n}") for n in sums), *(F.last(f"__b_{n}", True).over(earlier).alias(f"__c_{n}") for n in lasts))
    # keys may be null: they meet by position, not by equality
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "__block"]]
    joined = rows.alias("r").join(carried.alias("c"), same).select("r.*", *(f"c.__c_{n}" for n in {**sums, **lasts}))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    found = {n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    found |= {n: F.coalesce(F.last(f"__{n}", True).over(inside), F.col(f"__c_{n}")) for n in lasts}
    own = [c for c in rows.columns if not c.startswith("__")]
    return joined.select(*own, *(c.alias(n) for n, c in found.items()))
