"""Shared plumbing of the training-data operators: tables, scratch space, column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, persist, scratch_root

__all__ = ["discard", "fold_of", "free_name", "persist", "quoted", "scratch_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole input table, read by Spark from any store it can reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def quoted(name: str) -> Column:
    """A column by its exact name, also where that holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
