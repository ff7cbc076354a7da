"""Scans.  Every reader gives (rows, rejects): rows with ``_row_number`` first, rejects as
(row, error, raw).  Ragged JSON rows stay JSON text in the column ``json``."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import ContactError
from ..functions.shapes import shape_of

REJECT = "row long, error string, raw string"
JSON_BYTES = 50 * 1024 * 1024


def detect_format(path: str, explicit: str | None = None) -> str:
    """csv, json or jsonl: as asked, else by extension, else csv."""
    if explicit and explicit != "auto":
        if explicit not in ("csv", "json", "jsonl"):
            raise ContactError(f"unknown format {explicit!r}")
        return explicit
    return {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}.get(PurePosixPath(path).suffix.lower(), "csv")


def dedupe_headers(raw: list[str | None]) -> list[str]:
    """Blank headers become ``column_<i>``, repeats ``<name>__<n>``."""
    seen: dict[str, int] = {}
    taken = {h.strip() for h in raw if h and h.strip()}
    out: list[str] = []
    for i, h in enumerate(raw, 1):
        name = (h or "").strip() or f"column_{i}"
        if name in seen or (name in out):
            n = seen.get(name, 1) + 1
            while f"{name}__{n}" in taken or f"{name}__{n}" in out:
                n += 1
            seen[name] = n
            name = f"{name}__{n}"
        else:
            seen[name] = 1
        out.append(name)
    return out


def looks_headerless(headers: list[str]) -> bool:
    """True where a header is itself an e-mail, a phone number or a web address."""
    return any(shape_of(h, h) in ("email", "phone", "website") for h in headers)


def with_row_number(df: DataFrame, name: str = "_row_number", first: int = 1) -> DataFrame:
    """Consecutive numbers in file order: one count for each partition, then its offset.

    The numbers are those of a second scan, so the source must be stable, as files are.
    """
    marked = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = sorted((r["_pid"], r["n"]) for r in marked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    offsets, total = [], first
    for pid, n in counts:
        offsets.append((pid, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")).select(F.col(name), *(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
    ahead = F.broadcast(df.sparkSession.createDataFrame(offsets, "_pid int, _ahead long"))  # one row a partition
    inside = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return marked.join(ahead, "_pid").select((F.col("_ahead") + inside).cast("long").alias(name), *(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """RFC quoting, quoted line ends, a byte-order mark, surplus cells dropped, short rows padded
    with empty texts.  Row numbers count records, the header being record 1."""
    options = {"multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    head = spark.read.options(**options).csv(path).head(1)
    if not head:
        empty = spark.createDataFrame([], "_row_number long")
        return empty, spark.createDataFrame([], REJECT)
    first = [h.lstrip("﻿") if k == 0 and h else h for k, h in enumerate(head[0])]
    names = dedupe_headers(first)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = spark.read.options(**options, header=True, enforceSchema=True).schema(schema).csv(path)
    quoted = [F.coalesce(F.col("`" + n.replace("`", "``") + "`"), F.lit("")).alias(n) for n in names]
    return with_row_number(body.select(*quoted), first=2), spark.createDataFrame([], REJECT)


def _split(rows: DataFrame, raw: Column) -> tuple[DataFrame, DataFrame]:
    kind = F.schema_of_variant(F.try_parse_json(raw))
    error = F.when(kind.isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "row is not a JSON object")
    judged = rows.withColumn("_error", error)
    good = judged.where("_error is null").select("_row_number", raw.alias("json"))
    return good, judged.where("_error is not null").select(F.col("_row_number").alias("row"), F.col("_error").alias("error"), raw.alias("raw"))


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object a line; blank lines are skipped, other lines rejected with their number."""
    lines = with_row_number(spark.read.text(path))
    text = F.regexp_replace("value", "^﻿", "")
    return _split(lines.withColumn("value", text).where("trim(value) <> ''"), F.col("value"))


def file_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def read_json(spark: SparkSession, path: str, max_bytes: int | None = JSON_BYTES) -> tuple[DataFrame, DataFrame]:
    """An object is one row, an array its elements; a scalar no row.  Guarded by size, as one task
    parses the file."""
    if max_bytes and (size := file_bytes(spark, path)) > max_bytes:
        raise ContactError(f"{path} has {size} bytes, more than the {max_bytes} allowed; use JSON lines")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    broken = whole.where(kind.isNull() & (F.trim("value") != ""))
    if not broken.isEmpty():
        raise ContactError(f"{path} is not valid JSON")
    items = F.when(kind.startswith("ARRAY"), F.from_json("value", "array<string>")).when(kind.startswith("OBJECT"), F.array("value")).otherwise(F.array().cast("array<string>"))
    rows = whole.select(F.posexplode(items).alias("pos", "value")).select((F.col("pos") + 1).cast("long").alias("_row_number"), "value")
    return _split(rows, F.coalesce("value", F.lit("null")))


def read_rows(spark: SparkSession, path: str, fmt: str | None = None, *, max_json_bytes: int | None = JSON_BYTES, fail_fast: bool = False) -> tuple[str, DataFrame, DataFrame]:
    """(format, rows, rejects); ``fail_fast`` raises on the first rejected row."""
    fmt = detect_format(path, fmt)
    rows, rejects = read_csv(spark, path) if fmt == "csv" else read_jsonl(spark, path) if fmt == "jsonl" else read_json(spark, path, max_json_bytes)
    if fail_fast and (bad := rejects.orderBy("row").limit(1).collect()):
        raise ContactError(f"row {bad[0]['row']}: {bad[0]['error']}")
    return fmt, rows, rejects
