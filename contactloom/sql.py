"""SQL functions of the kernels that have no native expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .aliases import AliasRegistry
from .functions.names import normalize_name
from .functions.phones import format_e164, is_number_match
from .headers import HeaderResolver, default_strategies
from .session import ship


def register_functions(spark: SparkSession) -> None:
    """contact_e164(value, region), contact_name(value), contact_phone_match(a, b, region) and
    contact_field(header), as vectorised SQL functions."""
    ship(spark)

    @F.pandas_udf("string")
    def e164(value: pd.Series, region: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else format_e164(v, r) for v, r in zip(value, region, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def name(value: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else normalize_name(v) for v in value], dtype=object)

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series, region: pd.Series) -> pd.Series:
        return pd.Series([is_number_match(x or "", y or "", r) for x, y, r in zip(a, b, region, strict=True)], dtype="int32")

    @F.pandas_udf("string")
    def canonical(header: pd.Series) -> pd.Series:
        resolver = HeaderResolver(default_strategies(AliasRegistry())[:3])
        known = {h: resolver.identify(h).canonical for h in header.dropna().unique()}
        return header.map(known)

    for sql_name, function in (("contact_e164", e164), ("contact_name", name), ("contact_phone_match", agree), ("contact_field", canonical)):
        spark.udf.register(sql_name, function)
