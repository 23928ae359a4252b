"""Connected components of links between long ids, by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and one join; no neighbour list is ever gathered. The
minima of nodes with many links are broadcast instead, and their number is bounded. Links are cut to checkpoints, so a
lost executor costs one step, and lie in no more pieces than their number asks for, so that few links are few tasks and
files for the driver to keep. Empty links give an empty result; repeated links and links of a node with itself change
nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, hot_bound, join_split

#: Links of a piece, about.
PIECE_LINKS = 100_000


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a long, b long)`` to ``(node long, root long)``: every node that has a link to another, with the smallest node it reaches."""
    edges = _drop_loops(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges = checkpoint(edges)
    state = _state(edges)
    if not state[0]:
        return _rooted(edges)
    for _ in range(max_rounds):
        total = 2 * state[0]
        edges = _in_pieces(edges, total)
        edges = checkpoint(_in_pieces(_small_star(checkpoint(_in_pieces(_large_star(edges, total), total)), total), total))
        state, before = _state(edges), state
        if state == before:
            return _rooted(edges)
    raise RuntimeError("components did not settle")


def _rooted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _in_pieces(links: DataFrame, total: int) -> DataFrame:
    """Links, of which there are ``total`` at most, in fewer pieces if they are few."""
    return links.coalesce(math.ceil(total / PIECE_LINKS))


def _drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(_in_pieces(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), total))
    return _drop_loops(join_split(both.where("b > a"), least, "a", "n", hot_bound(total), total).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_split(edges, least, "a", "n", hot_bound(total), total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _drop_loops(moved.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
