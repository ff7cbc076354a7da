"""Structured Streaming: stateless mapping, running profiles, deduplication, quarantine."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dedupe import kept_orders
from ..operators.mapper import ContactMapper, profile_counts

__all__ = ["dedupe_stream", "map_stream", "profile_stream", "quarantine_stream"]


def map_stream(stream: DataFrame, mapper: ContactMapper | None = None, **options: object) -> DataFrame:
    """The mapper's rows over a stream: the same plan, stateless, constant memory."""
    return (mapper or ContactMapper()).map(stream, **options)


def profile_stream(results: DataFrame) -> DataFrame:
    """Running counts by kind and name; state is one row for each of them (complete or update mode)."""
    return profile_counts(results)


def _recorded(spark: SparkSession, state: str) -> DataFrame | None:
    """(key, batch) recorded so far, or None before any batch has written."""
    try:
        return spark.read.schema("key string, batch int").parquet(state)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def dedupe_stream(results: DataFrame, state: str, out: str, keys: str = "identity_keys", order: str = "_row_number") -> DataStreamWriter:
    """Keeps the first row of each identity, against the keys recorded by earlier batches.

    ``state`` is a folder of recorded keys, ``out`` of kept rows, one part for each batch.  A batch
    that runs again overwrites its own part, so a restart neither loses nor doubles rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("_id", F.monotonically_increasing_id() if order not in batch.columns else F.col(order))
        path = f"{state}/batch={number}"
        work = f"{out}/_work-{uuid.uuid4().hex}"
        batch.write.parquet(work)
        rows = spark.read.parquet(work)
        keyed = rows.select("_id", F.explode_outer(keys).alias("key"))
        if number and (known := _recorded(spark, state)) is not None:
            known = known.where(F.col("batch") < number).select("key")
            taken = rows.select("_id", F.explode(keys).alias("key")).join(known, "key", "left_semi").select("_id").distinct()
            keyed = keyed.join(taken, "_id", "left_anti")
        fresh = rows.join(keyed.select("_id").distinct(), "_id", "left_semi")
        kept = fresh.join(kept_orders(fresh.select(F.col("_id").alias("row"), F.col(keys).alias("keys"))).withColumnRenamed("row", "_id"), "_id", "left_semi")
        kept.drop("_id").write.mode("overwrite").parquet(f"{out}/batch={number}")
        done = spark.read.parquet(f"{out}/batch={number}")
        done.select(F.explode(keys).alias("key")).write.mode("overwrite").parquet(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(work)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return results.writeStream.foreachBatch(run)


def quarantine_stream(lines: DataFrame, good: str, bad: str, column: str = "value") -> DataStreamWriter:
    """Splits a stream of JSON lines into objects and quarantined lines, batch by batch."""

    def run(batch: DataFrame, number: int) -> None:
        kind = F.schema_of_variant(F.try_parse_json(F.col(column)))
        error = F.when(kind.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "row is not a JSON object")
        judged = batch.where(F.trim(F.col(column)) != "").withColumn("error", error)
        judged.where("error is null").select(F.col(column).alias("json")).write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.where("error is not null").select("error", F.col(column).alias("raw")).write.mode("overwrite").json(f"{bad}/batch={number}")

    return lines.writeStream.foreachBatch(run)
