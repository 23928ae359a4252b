"""Helpers that the operators of this subpackage share: tables, the shared folder, grouped Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file too small to be split well, dealt to all cores; larger inputs stay as they are read.

    Pieces of a file without the middle of a row group are empty, so few pieces tell nothing of how many tasks have rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage at files in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys that are broadcast because many rows have them, at most.
HOT_KEYS = 100_000


def hot_bound(n_rows: int) -> int:
    """Rows of a key beyond which it is hot: fewer than HOT_KEYS keys have so many."""
    return max(1_000, n_rows // HOT_KEYS)


def join_split(rows: DataFrame, side: DataFrame, key: str, n_col: str, bound: int, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each key once and in ``n_col`` how many rows have it.

    Keys of more than ``bound`` rows are broadcast, so that none fills a task; ``bound`` is ``hot_bound`` of the rows, so
    these are at most HOT_KEYS. The others are joined by a shuffle. If ``rows`` are known to be no more than ``bound`` in
    ``total``, no key can have more, and one join is the same.
    """
    if total is not None and total <= bound:
        return rows.join(side, key)
    hot = side.where(F.col(n_col) > bound)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.where(F.col(n_col) <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(few)


#: Rows of a side that is broadcast whole, at most.
FEW_ROWS = 1_000_000


def if_few(side: DataFrame) -> DataFrame:
    """A checkpointed side, to be broadcast if it has at most FEW_ROWS rows; a join with more shuffles, with the same result."""
    return F.broadcast(side) if side.count() <= FEW_ROWS else side


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id as long and text with null as the empty string; all other columns, clashing names included, are left out."""
    return df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only a few texts are held as Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch; null is the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys``; a group may go over the end of a batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rest = new if rest is None else pa.concat_tables([rest, new])
        starts = group_starts(rest, keys)
        last = int(starts[-1])
        if last:
            yield rest.slice(0, last)
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys begins in rows sorted by them."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = rows[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
