"""Sinks of result rows: CSV, JSON lines, one JSON array, quarantine."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import BOOLEAN_FIELDS, LIST_FIELDS, ContactError

MATERIALIZED_ROWS = 100_000


def _json_text(c: Column) -> Column:
    """A text as a JSON literal."""
    inside = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(inside.substr(F.lit(2), F.length(inside) - 2))


def _json_value(key: Column, vals: Column) -> Column:
    """Scalar for one value, array for more and for list fields, bare true and false in boolean fields."""
    one = F.get(vals, F.lit(0))
    bare = key.isin(*BOOLEAN_FIELDS) & one.isin("true", "false")
    every = F.concat(F.lit("["), F.array_join(F.transform(vals, _json_text), ","), F.lit("]"))
    return F.when(key.isin(*LIST_FIELDS) | (F.size(vals) != 1), every).when(bare, one).otherwise(_json_text(one))


def unmapped_names(keys: Sequence[str], taken: Sequence[str]) -> dict[str, str]:
    """Output names of unmapped headers: a clash with an output column gets ``__unmapped``, then ``_``."""
    used, out = set(taken), {}
    for k in keys:
        name = k if k not in used else f"{k}__unmapped"
        while name in used:
            name += "_"
        used.add(name)
        out[k] = name
    return out


def row_json(results: DataFrame, keep_unmapped: bool = False) -> Column:
    """One JSON object a row, non-ASCII text as it is."""
    entries = F.transform(F.map_entries("normalized"), lambda e: F.concat(_json_text(e["key"]), F.lit(":"), _json_value(e["key"], e["value"])))
    if keep_unmapped:

        def named(e: Column) -> Column:
            clash = F.map_contains_key("normalized", e["key"])
            return F.concat(_json_text(F.when(clash, F.concat(e["key"], F.lit("__unmapped"))).otherwise(e["key"])), F.lit(":"), _json_text(e["value"]))

        entries = F.concat(entries, F.transform(F.map_entries("unmapped"), named))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _first_seen(results: DataFrame, column: str) -> list[str]:
    """Keys of a map column by first appearance; headers or fields, not rows, reach the driver."""
    row = F.col("_row_number") if "_row_number" in results.columns else F.lit(0)
    seen = results.select(row.alias("row"), F.posexplode(F.map_keys(column)).alias("pos", "key"))
    return [r["key"] for r in seen.groupBy("key").agg(F.min(F.struct("row", "pos")).alias("at")).orderBy("at", "key").collect()]


def flat(results: DataFrame, keep_unmapped: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """Result rows as text columns: the fields that occur, lists joined by ``"; "``.

    Without ``fields`` one pass finds them, in the order of their first appearance: by
    ``_row_number`` where the results have it, then by place within a row.
    """
    if fields is None:
        fields = _first_seen(results, "normalized")
    columns = [F.array_join(F.col("normalized")[f], "; ").alias(f) for f in fields]
    if keep_unmapped:
        keys = _first_seen(results, "unmapped")
        columns += [F.col("unmapped")[k].alias(name) for k, name in unmapped_names(keys, fields).items()]
    return results.select(*columns)


@contextmanager
def atomic_file(path: str) -> Iterator[Path]:
    """A temporary file beside ``path`` that replaces it when the block ends well."""
    target = Path(path)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    os.close(fd)
    try:
        yield Path(name)
        os.replace(name, target)
    finally:
        Path(name).unlink(missing_ok=True)


def collect_capped(rows: DataFrame, cap: int | None) -> list:
    """All rows on the driver, or an error as soon as there are more than ``cap``."""
    if not cap:
        return rows.collect()
    found = rows.limit(cap + 1).collect()
    if len(found) > cap:
        raise ContactError(f"more than {cap} rows for a single-file output; write JSON lines, or raise the limit")
    return found


def write_results(results: DataFrame, path: str, fmt: str = "jsonl", *, keep_unmapped: bool = False, single_file: bool = False, max_rows: int | None = MATERIALIZED_ROWS) -> None:
    """Distributed output folders by default; ``single_file`` makes one local file, atomically.  JSON
    lines are written partition by partition, whatever their number; csv and json hold at most
    ``max_rows`` rows (0 or None: any number)."""
    if fmt == "csv":
        rows = flat(results, keep_unmapped)
        if not single_file:
            rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
            return
        import csv

        found = collect_capped(rows, max_rows)
        with atomic_file(path) as tmp, tmp.open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(rows.columns)
            out.writerows(["" if v is None else v for v in r] for r in found)
        return
    lines = results.select(row_json(results, keep_unmapped).alias("value"))
    if not single_file:
        lines.write.mode("overwrite").text(path)
        return
    import json

    with atomic_file(path) as tmp:
        if fmt == "json":
            found = collect_capped(lines, max_rows)
            tmp.write_text(json.dumps([json.loads(r[0]) for r in found], indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        else:
            with tmp.open("w", encoding="utf-8") as f:
                f.writelines(r[0] + "\n" for r in lines.toLocalIterator(prefetchPartitions=True))


def write_quarantine(rejects: DataFrame, path: str) -> int:
    """Rejected rows as JSON lines; nothing is written without any."""
    n = rejects.count()
    if n:
        rejects.select("row", "error", "raw").write.mode("overwrite").json(path)
    return n
