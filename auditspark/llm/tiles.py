"""Buckets of rows that are compared with one another, dealt out as tiles of bounded size.

A bucket of n rows becomes ceil(n / tile_rows) chunks, or more if its rows are large, and each pair of chunks is one tile with its own key, so that a
hot bucket is spread over many tasks and no task holds more than two chunks of it. Nothing is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, hot_bound, join_split

#: Sort keys of a tile; rows of one tile have them equal.
TILE = ["bucket", "tile_a", "tile_b"]


def deal_tiles(rows: DataFrame, row_id: str, tile_rows: int, deal: bool = True, weight: str | None = None, tile_weight: int = 1, owner: Column | None = None) -> DataFrame:
    """``rows`` with a long column ``bucket`` to the rows of all tiles, sorted by TILE, with the row's ``chunk``; buckets of one row are left out.
    Without ``deal`` the rows are not yet sorted, for a caller who adds columns first. With ``weight``, a column of what a
    row takes up, chunks hold about ``tile_weight`` of it at most, or one row. With ``owner``, buckets in which it holds for
    no row are left out.

    In a tile with tile_a < tile_b, pairs of one row of either chunk are to be compared; in one with tile_a = tile_b, all pairs.
    """
    counts = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("n_bucket"), (F.sum(weight) if weight else F.lit(0)).alias("weight_bucket"), F.bool_or(F.lit(True) if owner is None else owner).alias("owned")).where("n_bucket > 1 and owned").drop("owned"))
    total = counts.agg(F.coalesce(F.sum("n_bucket"), F.lit(0))).first()[0]
    chunks = F.least(F.col("n_bucket"), F.greatest(F.ceil(F.col("n_bucket") / tile_rows), F.ceil(F.col("weight_bucket") / tile_weight))).cast("int")
    dealt = (
        join_split(rows, counts, "bucket", "n_bucket", hot_bound(total), total)
        .withColumn("n_chunks", chunks)
        .drop("n_bucket", "weight_bucket")
        .withColumn("chunk", F.pmod(F.xxhash64(row_id), F.col("n_chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn("tile_a", F.least("chunk", "other").cast("int"))
        .withColumn("tile_b", F.greatest("chunk", "other").cast("int"))
        .drop("other", "n_chunks")
    )
    return dealt.repartition(*TILE).sortWithinPartitions(*TILE) if deal else dealt
