"""Header resolution for tables of headers, where there are too many for the driver.

Exact matches are an equi-join with the alias dimension (a few thousand rows of the vocabulary,
broadcast); rewritten and misspelt headers go through one Arrow UDF over the distinct rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..aliases import AliasRegistry
from ..fields import EXACT
from ..functions.values import trim
from ..headers import HeaderResolver, default_strategies

VERDICT = "canonical string, confidence double, strategy string"


def resolve_headers(headers: DataFrame, column: str = "header", registry: AliasRegistry | None = None) -> DataFrame:
    """(header, canonical, confidence, strategy) for each distinct header; null headers are left out."""
    registry = registry or AliasRegistry()
    distinct = headers.select(F.col(column).alias("header")).where("header is not null").distinct().withColumn("alias", F.lower(trim(F.col("header"))))
    dimension = headers.sparkSession.createDataFrame([(a, f) for a, f, *_ in registry.rows()], "alias string, found string")
    joined = distinct.join(F.broadcast(dimension), "alias", "left")
    exact = joined.where("found is not null").select("header", F.col("found").alias("canonical"), F.lit(EXACT).alias("confidence"), F.lit("exact").alias("strategy"))

    @F.pandas_udf(VERDICT)
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        resolver = HeaderResolver(default_strategies(registry)[1:3])
        for batch in batches:
            found = [resolver.identify(h) for h in batch]
            yield pd.DataFrame([(m.canonical, m.confidence, m.strategy) for m in found], columns=["canonical", "confidence", "strategy"])

    rest = joined.where("found is null").select("header", resolve("header").alias("v")).select("header", "v.*")
    return exact.union(rest)
