"""Command line: ``map``, ``profile``, ``explain``, ``fields``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aliases import VERSION
from .fields import UNKNOWN, CanonicalField, ContactError
from .operators.dedupe import dedupe
from .operators.mapper import ContactMapper, profile_results
from .operators.reports import explain_profile, profile_dict, run_stats
from .plans.mapping import MappingPlan
from .session import ship
from .sources.readers import JSON_BYTES, detect_format, looks_headerless, read_rows
from .sources.writers import MATERIALIZED_ROWS, row_json, write_quarantine, write_results
from .storage import discard, persist

OK, ERROR, PARTIAL = 0, 1, 2
SUMMARY = 20


def _natural(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def _overrides(pairs: list[str]) -> dict[str, str]:
    out = {}
    for p in pairs:
        header, mark, field = p.partition("=")
        if not mark or not header.strip() or field not in {f.value for f in CanonicalField} - {UNKNOWN}:
            raise ContactError(f"override {p!r} must be HEADER=field with a known field")
        out[header] = field
    return out


def _languages(text: str | None) -> str | list[str] | None:
    return None if not text else "all" if text.strip() == "all" else [c.strip() for c in text.split(",") if c.strip()]


def _mapper(args: argparse.Namespace) -> ContactMapper:
    return ContactMapper(default_region=args.region, languages=_languages(args.languages), overrides=_overrides(args.override), confidence_threshold=getattr(args, "min_confidence", 0.0))


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("contactloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    return spark


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _mapped(mapper: ContactMapper, fmt: str, rows: DataFrame, **options: object) -> DataFrame:
    if fmt == "csv":
        return mapper.map(rows, keep=["_row_number"], **options)
    return mapper.map_json(rows, keep=["_row_number"], **options)


def summary(title: str, counts: list[tuple[str, int]]) -> str:
    """Columns by rows descending, then name; the first twenty."""
    shown = sorted(counts, key=lambda x: (-x[1], x[0]))
    lines = [f"  {name}: {n} row(s)" for name, n in shown[:SUMMARY]]
    more = [f"  … and {len(shown) - SUMMARY} more"] if len(shown) > SUMMARY else []
    return "\n".join([f"{title}: {len(shown)} column(s)", *lines, *more])


def _same(a: str | None, b: str | None) -> bool:
    return bool(a and b) and os.path.realpath(a) == os.path.realpath(b)


def run_map(args: argparse.Namespace) -> int:
    out, quarantine = args.output, args.quarantine_output
    if quarantine and args.on_error != "quarantine":
        raise ContactError("--quarantine-output needs --on-error quarantine")
    if args.on_error == "quarantine" and not quarantine:
        quarantine = f"{out or args.input}.quarantine.jsonl"
    if _same(out, args.input) or _same(quarantine, args.input) or _same(quarantine, out):
        raise ContactError("input, output and quarantine must be different files")
    fmt = args.format or (detect_format(out) if out else "json")
    mapper, spark = _mapper(args), _spark()
    region = args.region
    if args.schema_in:
        region = MappingPlan.load(args.schema_in, mapper).default_region or region
    in_fmt, rows, rejects = read_rows(spark, args.input, args.in_format, max_json_bytes=args.max_json_input_bytes, fail_fast=args.on_error == "fail")
    headers = [c for c in rows.columns if c != "_row_number"]
    if in_fmt == "csv" and looks_headerless(headers):
        _say("warning: the first line looks like data, not like headers")
    # Mapped once: warnings, statistics, the count and the output all read the written rows.
    results = written = persist(_mapped(mapper, in_fmt, rows, normalize=not args.no_normalize, extract_embedded_phones=args.embedded_phones, default_region=region), "cli-mapped")
    if args.strict:
        bad = results.where(F.size("warnings") > 0).select(F.col("_row_number").alias("row"), F.array_join("warnings.message", "; ").alias("error"), F.lit(None).cast("string").alias("raw"))
        if args.on_error == "fail" and (first := bad.orderBy("row").limit(1).collect()):
            raise ContactError(f"row {first[0]['row']}: {first[0]['error']}")
        rejects = rejects.union(bad)
        results = results.where(F.size("warnings") == 0)
    verdicts = sorted(run_stats(results).collect(), key=lambda v: v["header"])
    total = results.count()
    if args.dedupe:
        results = dedupe(results, "identity_keys", "_row_number")
    results = results.orderBy("_row_number") if fmt != "jsonl" or not out or args.dedupe else results
    if out:
        write_results(results, out, fmt, keep_unmapped=args.keep_unmapped, single_file=True, max_rows=args.max_materialized_rows)
    else:
        found = [json.loads(r[0]) for r in results.select(row_json(results, args.keep_unmapped)).collect()]
        print(json.dumps(found, indent=2, ensure_ascii=False) if fmt == "json" else "\n".join(json.dumps(r, ensure_ascii=False) for r in found))
    kept = results.count() if args.dedupe else total
    failed = write_quarantine(rejects, quarantine) if args.on_error == "quarantine" else rejects.count()
    discard(written)
    if args.schema_out:
        seen = headers if in_fmt == "csv" else list(dict.fromkeys(v["header"] for v in verdicts))
        mapper.compile_plan(seen, default_region=region).save(args.schema_out)
    dropped = [(v["header"], v["rows"]) for v in verdicts if v["dropped"]]
    low = [(f"{v['header']} -> {v['canonical']}", v["rows"]) for v in verdicts if v["low"]]
    if dropped and not args.keep_unmapped:
        _say(summary("Dropped", dropped))
    if low:
        _say(summary("Low confidence", low))
    notes = [f"{total - kept} duplicate(s)"] * bool(total - kept) + [f"{failed} {'quarantined' if args.on_error == 'quarantine' else 'skipped'}"] * bool(failed)
    _say(f"Mapped {kept} row(s) -> {out or 'stdout'} ({fmt})" + (", " + ", ".join(notes) if notes else ""))
    return PARTIAL if failed else OK


def run_profile(args: argparse.Namespace) -> int:
    mapper, spark = _mapper(args), _spark()
    fmt, rows, _ = read_rows(spark, args.input, args.in_format, max_json_bytes=args.max_json_input_bytes, fail_fast=True)
    if args.max_rows:
        rows = rows.orderBy("_row_number").limit(args.max_rows)
    results = _mapped(mapper, fmt, rows, normalize=not args.no_normalize, extract_embedded_phones=args.embedded_phones)
    row = profile_results(results).first()
    print(json.dumps(profile_dict(row), indent=2, ensure_ascii=False) if args.json else explain_profile(row))
    return OK


def run_explain(args: argparse.Namespace) -> int:
    m = _mapper(args).identify(args.header, args.value)
    print(f"{m.original!r} -> {m.canonical} (confidence {m.confidence:.2f}, strategy {m.strategy})")
    return OK


def run_fields(args: argparse.Namespace) -> int:
    print("\n".join(f.value for f in CanonicalField))
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contactloom")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def common(c: argparse.ArgumentParser) -> None:
        c.add_argument("--region", default="US")
        c.add_argument("--languages")
        c.add_argument("--override", action="append", default=[], metavar="HEADER=field")

    def reading(c: argparse.ArgumentParser) -> None:
        c.add_argument("input")
        c.add_argument("--in-format", choices=["auto", "csv", "json", "jsonl"], default="auto")
        c.add_argument("--min-confidence", type=float, default=0.0)
        c.add_argument("--no-normalize", action="store_true")
        c.add_argument("--embedded-phones", action="store_true")
        c.add_argument("--max-json-input-bytes", type=_natural, default=JSON_BYTES)

    m = sub.add_parser("map")
    common(m)
    reading(m)
    m.add_argument("-o", "--output")
    m.add_argument("--format", choices=["csv", "json", "jsonl"])
    m.add_argument("--strict", action="store_true")
    m.add_argument("--on-error", choices=["fail", "skip", "quarantine"], default="fail")
    m.add_argument("--quarantine-output")
    m.add_argument("--max-materialized-rows", type=_natural, default=MATERIALIZED_ROWS)
    m.add_argument("--keep-unmapped", action="store_true")
    m.add_argument("--dedupe", action="store_true")
    m.add_argument("--schema-out")
    m.add_argument("--schema-in")
    m.set_defaults(run=run_map)
    f = sub.add_parser("profile")
    common(f)
    reading(f)
    f.add_argument("--max-rows", type=_natural, default=0)
    f.add_argument("--json", action="store_true")
    f.set_defaults(run=run_profile)
    e = sub.add_parser("explain")
    common(e)
    e.add_argument("header")
    e.add_argument("--value")
    e.set_defaults(run=run_explain)
    sub.add_parser("fields").set_defaults(run=run_fields)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if getattr(args, "input", None) and not args.input.startswith(("hdfs:", "s3", "viewfs:", "file:", "abfs")) and not Path(args.input).exists():
            raise ContactError(f"no such file: {args.input}")
        return args.run(args)
    except (ContactError, ValueError) as error:
        _say(f"error: {error}")
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
