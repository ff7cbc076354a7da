"""Drop rows that share an identity key with an earlier kept row.

Rows are taken in order; a row goes when any of its keys was recorded by a row kept before it, and
a dropped row records nothing.  That is the lexicographically first independent set, found in
rounds: a row that comes first for all of its keys stays, rows that share a key with it go, and the
rest go on.  A round is a partially aggregated minimum by key and joins against it, so popular keys
never gather their rows in one task.

Long chains of keys would take many rounds.  After ``ROUNDS`` of them the rest falls into connected
components; those of at most ``COMPONENT_KEYS`` keys are finished in order by one task each, and only
larger ones go on in rounds.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import persist
from .components import connected_components

ROUNDS = 6
COMPONENT_KEYS = 200_000


def dedupe(df: DataFrame, keys: str = "identity_keys", order: str = "_row_number") -> DataFrame:
    """Rows of ``df`` that stay.  ``keys`` is ARRAY<STRING>, ``order`` a unique number.

    Rows without keys (null or empty) always stay.  An empty table stays empty.
    """
    return df.join(kept_orders(df.select(F.col(order).alias("row"), F.col(keys).alias("keys"))).withColumnRenamed("row", order), order, "left_semi")


def kept_orders(rows: DataFrame) -> DataFrame:
    """(row) of the rows that stay, from (row, keys)."""
    keyless = rows.where(F.coalesce(F.size(F.array_compact("keys")), F.lit(0)) <= 0).select("row")
    left = persist(rows.select("row", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")), "dedupe-keys")
    kept, done = [keyless], 0
    while not left.isEmpty():
        first = left.groupBy("key").agg(F.min("row").alias("first"))
        ranked = left.join(first, "key")
        if done == ROUNDS:
            finished, left = _small_components(left, ranked)
            kept.append(finished)
            done += 1
            continue
        stay = persist(ranked.groupBy("row").agg(F.max(F.col("row") - F.col("first")).alias("behind")).where("behind = 0").select("row"), "dedupe-kept")
        kept.append(stay)
        taken = left.join(stay, "row", "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select("row").distinct()
        left = persist(left.join(gone, "row", "left_anti"), "dedupe-keys")
        done += 1
    return reduce(DataFrame.union, kept)


def _small_components(left: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept rows of the components that one task can finish, and the keys of the others."""
    roots = connected_components(ranked.select(F.col("row").alias("a"), F.col("first").alias("b")), "dedupe-components")
    marked = left.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    marked = persist(marked, "dedupe-marked")
    sizes = persist(marked.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "dedupe-sizes")
    sized = marked.join(sizes, "root")

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        kept = []
        for row, keys in group.groupby("row", sort=True)["key"]:
            if taken.isdisjoint(keys):
                taken.update(keys)
                kept.append(row)
        return pd.DataFrame({"row": pd.Series(kept, dtype=group["row"].dtype)})

    small = sized.where(F.col("n") <= COMPONENT_KEYS)
    finished = persist(small.select("root", "row", "key").groupBy("root").applyInPandas(in_order, left.select("row").schema), "dedupe-kept")
    return finished, persist(sized.where(F.col("n") > COMPONENT_KEYS).select("row", "key"), "dedupe-keys")


def dedupe_single(df: DataFrame, key: str, order: str) -> DataFrame:
    """The same where each row has at most one key: the first row of each key, and keyless rows."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = df.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.union(df.where(F.col(key).isNull()))
