"""Reports on mapped rows: JSON and text for single rows and profiles, statistics of a run."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..fields import NORMALIZED, UNKNOWN
from ..sources.writers import row_json


def result_json(results: DataFrame) -> Column:
    """A whole result row as JSON; the match rate is rounded half-even to four digits."""
    rest = F.to_json(F.struct("unmapped", "field_matches", "warnings", F.bround("match_rate", 4).alias("match_rate"), "matched", "unmatched"), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"normalized":'), row_json(results), F.lit(","), F.substring(rest, 2, 1 << 30))


def explain_result(row: Row) -> str:
    """Text about one result row."""
    lines = [f"matched {row['matched']} of {row['matched'] + row['unmatched']} fields ({row['match_rate']:.0%})"]
    lines += [f"  {m['original']!r} -> {m['canonical']} ({m['strategy']}, {m['confidence']:.2f})" for m in row["field_matches"]]
    lines += [f"  ! {w['message']}" for w in row["warnings"]]
    return "\n".join(lines)


def profile_dict(row: Row) -> dict[str, Any]:
    """A profile row as a plain dictionary, the match rate rounded to four digits."""
    return row.asDict() | {"match_rate": round(row["match_rate"], 4)}


def explain_profile(row: Row) -> str:
    """Text about a profile; each section by count descending, then name."""
    lines = [f"rows: {row['rows_seen']}", f"fields: {row['fields_seen']}", f"matched: {row['matched']}", f"unmatched: {row['unmatched']}", f"match rate: {row['match_rate']:.2%}", f"warnings: {row['warning_count']}"]
    for kind in ("canonical", "unmapped", "strategy", "warning"):
        counts = row[f"{kind}_counts"] or {}
        if counts:
            lines += [f"{kind}:", *(f"  {name}: {n}" for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
    return "\n".join(lines)


def run_stats(results: DataFrame) -> DataFrame:
    """(header, canonical, confidence, rows, dropped, low): one row for each verdict of a run.

    ``dropped`` headers are mapped to nothing, ``low`` ones below the confidence of a normalised match.
    """
    m = results.select(F.explode("field_matches").alias("m")).select("m.*")
    counted = m.groupBy(F.col("original").alias("header"), "canonical", "confidence").agg(F.count(F.lit(1)).alias("rows"))
    dropped = F.col("canonical") == UNKNOWN
    return counted.select("*", dropped.alias("dropped"), (~dropped & (F.col("confidence") < NORMALIZED)).alias("low"))
