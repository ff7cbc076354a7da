"""Connected components of an edge table by alternating large-star and small-star rounds.

The rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) only use
partially aggregated minima and equi-joins against them.  The minima are written first: a join
with a written table is broadcast where that is small and otherwise shuffles both sides, so that
adaptive execution can split a hub's edges over tasks, which it cannot above an aggregate by the
join key.  Each round is written to the shared folder: a lost executor costs one round, and the
round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, persist

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The larger neighbours of each vertex linked to its smallest one (or itself); the minima."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = persist(both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo")), label)
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("lo").alias("b")), low


def _small_star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Each vertex and its smaller neighbours linked to the smallest; the minima."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = persist(down.groupBy("a").agg(F.min("b").alias("lo")), label)
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
    return moved.where(F.col("a") != F.col("b")).union(low.select("a", F.col("lo").alias("b"))), low


def _is_settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each vertex that points to a smaller one points to one only, and
    none points to it."""
    ends = edges.select(F.col("a").alias("node"), F.when(F.col("a") > F.col("b"), 1).otherwise(2).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    ups = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ups.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (a, b of one orderable type) -> (node, root): the smallest node each can reach.

    Self-loops, repeated edges and null ends are ignored; nodes without an edge do not appear
    (each is its own root).  An empty edge table gives an empty result.
    """
    now = persist(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), label)
    for _ in range(MAX_ROUNDS):
        if _is_settled(now):
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        starred, first = _large_star(now, label)
        middle = persist(starred.distinct(), label)
        starred, second = _small_star(middle, label)
        new = persist(starred.distinct(), label)
        discard(now, first, middle, second)
        now = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
