"""Written tables in the folder that the cluster shares, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where that is unset a local session gets a private
    folder; on a cluster executors would each write to disks of their own, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = path = tempfile.mkdtemp(prefix="contactloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{_OWN[app]}"


def persist(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`persist` that nothing lazy reads any more."""
    for table in tables:
        _WRITTEN.remove(table._written_at)
        _delete(table.sparkSession, table._written_at)


def release(spark: SparkSession) -> int:
    """Delete the tables written so far, once no result that reads them is needed; their number."""
    done = 0
    while _WRITTEN:
        done += _delete(spark, _WRITTEN.pop())
    return done
