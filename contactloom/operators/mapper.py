"""The mapper: resolves headers on the driver and compiles rows to one narrow stage.

``map_columns`` renames and normalises columns.  ``map`` builds whole result rows: shape verdicts
for unknown headers, merged values, warnings, match rate, identity keys.  Neither shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..aliases import AliasRegistry
from ..fields import (
    DATE_FIELDS,
    EMBEDDED_PER_FIELD,
    EMBEDDED_PER_ROW,
    EMBEDDED_TEXT,
    HEADER_CACHE,
    LIST_FIELDS,
    MAX_DEPTH,
    NAME_FIELDS,
    PHONE_FIELDS,
    SHAPE,
    UNKNOWN,
    ContactError,
    NormalizationError,
    WarningCategory,
)
from ..functions.phones import e164, embedded_numbers
from ..functions.shapes import phone_candidate, reachable, shape_column
from ..functions.values import WARNING, base_parts, base_text, normalize_column, trim, value_warning, warning
from ..headers import FieldMatch, HeaderResolver, ShapeStrategy, Strategy, default_strategies, unknown
from ..plans.mapping import MappingPlan

ENTRY = "struct<pos:int,field:string,values:array<string>>"
MERGED = "struct<pos:int,key:string,value:array<string>>"
PAIR = "struct<key:string,value:string>"
MATCH = "struct<original:string,canonical:string,confidence:double,strategy:string,service:string>"


@dataclass
class Cell:
    """One input column: its header, value as text, kind, presence and verdict."""

    header: str
    value: Column
    kind: str  # string, scalar, array, object
    present: Column | None
    match: FieldMatch | None


def _check_threshold(value: float | None) -> float:
    if value is None:
        return 0.0
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError("confidence_threshold must be between 0 and 1")
    return float(value)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flatten_columns(df: DataFrame, depth: int = 1) -> list[tuple[str, Column, T.DataType]]:
    """(path, column, type) of a DataFrame's columns, structs opened up to ``depth`` levels (1 to 5)."""
    depth = max(1, min(MAX_DEPTH, depth))
    out: list[tuple[str, Column, T.DataType]] = []

    def walk(path: str, c: Column, kind: T.DataType, level: int) -> None:
        if isinstance(kind, T.StructType) and level < depth:
            for f in kind.fields:
                walk(f"{path}.{f.name}", c.getField(f.name), f.dataType, level + 1)
        else:
            out.append((path, c, kind))

    for f in df.schema.fields:
        walk(f.name, F.col(_quote(f.name)), f.dataType, 1)
    return out


def _blank(x: Column) -> Column:
    return x.isNull() | (trim(x) == "")


class ContactMapper:
    """Maps contact tables onto the canonical fields.  Extra keyword arguments ``service`` and
    ``default_service`` are accepted and ignored."""

    def __init__(
        self,
        registry: AliasRegistry | None = None,
        *,
        patterns: Mapping[str, Any] | None = None,
        patterns_path: str | None = None,
        overrides: Mapping[str, str] | None = None,
        languages: str | Iterable[str] | None = None,
        strategies: Sequence[Strategy] | None = None,
        default_region: str | None = "US",
        confidence_threshold: float = 0.0,
        cache_size: int | None = HEADER_CACHE,
        service: str | None = None,
        default_service: str | None = None,
    ):
        self.registry = registry or AliasRegistry(patterns, patterns_path, overrides, languages)
        self.default_region = default_region
        self.confidence_threshold = _check_threshold(confidence_threshold)
        self.resolver = HeaderResolver(default_strategies(self.registry) if strategies is None else strategies, cache_size)

    def identify(self, header: str, value: object = None, default_region: str | None = None, service: str | None = None) -> FieldMatch:
        """The whole strategy chain for one header, uncached."""
        return self.resolver.identify(header, value, default_region or self.default_region)

    def clear_cache(self) -> None:
        self.resolver.clear()

    def cache_info(self) -> dict[str, int | None]:
        return self.resolver.info()

    def __repr__(self) -> str:
        return f"ContactMapper({self.registry!r}, default_region={self.default_region!r})"

    # Plans

    def _threshold(self, value: float | None) -> float:
        return self.confidence_threshold if value is None else _check_threshold(value)

    @staticmethod
    def _low(m: FieldMatch, threshold: float) -> str:
        return f"{m.original!r}: dropped low-confidence match to {m.canonical!r} (confidence {m.confidence:.2f} < threshold {threshold:.2f})"

    def compile_plan(self, headers: Iterable[str], *, confidence_threshold: float | None = None, strict: bool = False, default_region: str | None = None) -> MappingPlan:
        """Header verdicts only; value shapes play no part."""
        threshold, matches, dropped = self._threshold(confidence_threshold), {}, []
        for header in headers:
            m = self.resolver.of_header(header) or unknown(header)
            if m.canonical != UNKNOWN and m.confidence < threshold:
                dropped.append(self._low(m, threshold))
                m = unknown(header)
            matches[header] = m
        if strict and dropped:
            raise NormalizationError("; ".join(dropped))
        return MappingPlan(matches, self, default_region or self.default_region)

    # Columns

    def output_names(self, columns: Sequence[str], plan: MappingPlan) -> list[str]:
        """Canonical names, ``__N`` from the second on; unmatched columns keep theirs."""
        if len(set(columns)) != len(columns):
            raise ValueError("duplicate column names: " + ", ".join(sorted({c for c in columns if list(columns).count(c) > 1})))
        taken = {c for c in columns if plan.matches[c].canonical == UNKNOWN}
        names = []
        for c in columns:
            field = plan.matches[c].canonical
            name, n = (c, 1) if field == UNKNOWN else (field, 1)
            while field != UNKNOWN and name in taken:
                n += 1
                name = f"{field}__{n}"
            taken.add(name)
            names.append(name)
        return names

    def map_columns(self, df: DataFrame, *, normalize: bool = True, default_region: str | None = None, confidence_threshold: float | None = None, strict: bool = False) -> DataFrame:
        """``df`` with matched columns renamed and normalised; strict raises on any warning."""
        region = default_region or self.default_region
        plan = self.compile_plan(df.columns, confidence_threshold=confidence_threshold, strict=strict, default_region=region)
        # Stripped texts are a step of their own: normalisers read them more than once.
        fields = {c: plan.matches[c].canonical for c in df.columns if normalize and plan.matches[c].canonical != UNKNOWN and isinstance(df.schema[c].dataType, T.StringType)}
        texts = {c: f"_text{k}_{len(df.columns)}" for k, c in enumerate(fields) if fields[c] not in (*PHONE_FIELDS, *NAME_FIELDS)}
        parts = {c: f"_part{k}_{len(df.columns)}" for k, c in enumerate(texts) if fields[c] in (*DATE_FIELDS, *LIST_FIELDS)}
        step = df.select("*", *(base_text(fields[c], F.col(_quote(c))).alias(name) for c, name in texts.items()))
        step = step.select("*", *(base_parts(fields[c], F.col(texts[c])).alias(name) for c, name in parts.items()))
        out = []
        for c, name in zip(df.columns, self.output_names(df.columns, plan), strict=True):
            field, column = plan.matches[c].canonical, F.col(_quote(c))
            if normalize and field != UNKNOWN and isinstance(df.schema[c].dataType, T.StringType):
                column = normalize_column(field, column, region, *(F.col(names[c]) if c in names else None for names in (texts, parts)))
            elif normalize and field in LIST_FIELDS and isinstance(df.schema[c].dataType, T.ArrayType):
                column = F.filter(F.transform(column, lambda x: trim(x.cast("string"))), lambda x: x != "")
            out.append(column.alias(name))
        mapped = step.select(*out)
        if strict and (found := self.column_warnings(df, normalize=normalize, default_region=region).limit(20).collect()):
            raise NormalizationError("; ".join(r["message"] for r in found))
        return mapped

    def column_warnings(self, df: DataFrame, *, normalize: bool = True, default_region: str | None = None, dates: bool = False) -> DataFrame:
        """(category, message, header) of phone and e-mail columns, and of dates when asked."""
        region = default_region or self.default_region
        found = []
        for c in df.columns:
            m = self.resolver.of_header(c)
            if m is not None and isinstance(df.schema[c].dataType, T.StringType):
                value = normalize_column(m.canonical, F.col(_quote(c)), region) if normalize and m.canonical not in LIST_FIELDS else F.col(_quote(c))
                w = value_warning(c, m.canonical, value, dates)
                if w is not None:
                    found.append(w)
        if not found:
            return df.sparkSession.createDataFrame([], T._parse_datatype_string(WARNING))
        return df.select(F.explode(F.array_compact(F.array(*found))).alias("w")).select("w.*")

    # Rows

    def _cells(self, df: DataFrame, depth: int, skip: Sequence[str]) -> list[Cell]:
        cells = []
        for path, c, kind in flatten_columns(df, depth):
            if path in skip:
                continue
            if isinstance(kind, T.StringType):
                name, value = "string", c
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
                name, value = "array", c
            elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                name, value = "object", F.to_json(c)
            else:
                name, value = "scalar", c.cast("string")
            cells.append(Cell(path, value, name, None, self.resolver.of_header(path)))
        return cells

    def map(
        self,
        df: DataFrame,
        *,
        keep: Sequence[str] = (),
        normalize: bool = True,
        depth: int = 1,
        default_region: str | None = None,
        confidence_threshold: float | None = None,
        extract_embedded_phones: bool = False,
        strict: bool = False,
        service: str | None = None,
    ) -> DataFrame:
        """Result rows of ``df``: the ``keep`` columns, then normalized (MAP<STRING,ARRAY<STRING>>),
        unmapped (MAP<STRING,STRING>), field_matches, warnings, matched, unmatched, match_rate,
        identity_keys."""
        result = self._build(df.select("*"), self._cells(df, depth, keep), keep, normalize, default_region, confidence_threshold, extract_embedded_phones)
        return self._strictly(result) if strict else result

    def map_json(self, df: DataFrame, column: str = "json", *, keep: Sequence[str] = (), depth: int = 1, headers: Sequence[str] | None = None, **options: Any) -> DataFrame:
        """The same for ragged rows: ``column`` holds one JSON object a row.

        Headers are found by one pass over the keys unless given, and more than 10,000 of them are an
        error; rows have only the cells whose keys they hold.  Keys of nested objects are opened up to ``depth``.
        """
        strict = options.pop("strict", False)
        if headers is None:
            headers = json_headers(df, column, depth)
        # Each object is parsed once, to a map of its values' texts; nested ones from their text.
        parsed = df.withColumn("_doc", F.from_json(F.col(_quote(column)), "map<string,string>"))
        opened, cells = {"": "_doc"}, []
        for h in headers:
            parts = h.split(".") if depth > 1 else [h]
            for n in range(1, len(parts)):
                path, above = ".".join(parts[:n]), ".".join(parts[: n - 1])
                if path not in opened:
                    opened[path] = f"_doc{len(opened)}"
                    parsed = parsed.withColumn(opened[path], F.from_json(F.col(opened[above])[parts[n - 1]], "map<string,string>"))
            doc = F.col(opened[".".join(parts[:-1])])
            cells.append(Cell(h, doc[parts[-1]], "string", F.coalesce(F.map_contains_key(doc, parts[-1]), F.lit(False)), self.resolver.of_header(h)))
        result = self._build(
            parsed, cells, keep, options.pop("normalize", True), options.pop("default_region", None), options.pop("confidence_threshold", None), options.pop("extract_embedded_phones", False)
        )
        return self._strictly(result) if strict else result

    @staticmethod
    def _strictly(result: DataFrame) -> DataFrame:
        found = result.where(F.size("warnings") > 0).select("warnings.message").limit(20).collect()
        if found:
            raise NormalizationError("; ".join(m for r in found for m in r["message"]))
        return result

    def _build(self, df: DataFrame, cells: list[Cell], keep: Sequence[str], normalize: bool, region: str | None, threshold: float | None, embedded: bool) -> DataFrame:
        """Result rows in steps, each of which names what the next one uses more than once."""
        region, floor = region or self.default_region, self._threshold(threshold)
        valued = [s for s in self.resolver.strategies if not s.header_only]
        custom = any(not isinstance(s, ShapeStrategy) for s in valued)
        more = tuple(dict.fromkeys(f for s in valued for f in s.fields))
        kept = [F.col(_quote(k)) for k in keep]
        static = {k: c.match.canonical for k, c in enumerate(cells) if c.match is not None and c.match.canonical != UNKNOWN and c.match.confidence >= floor}
        asked = [k for k, c in enumerate(cells) if c.match is None and valued and c.kind in ("string", "scalar")]
        wide = [c.value.alias(f"_c{k}") for k, c in enumerate(cells)] + [c.present.alias(f"_p{k}") for k, c in enumerate(cells) if c.present is not None]
        step = df.select(*kept, *wide)
        step = step.select("*", *(trim(F.col(f"_c{k}")).alias(f"_t{k}") for k in asked))
        step = step.select("*", *(phone_candidate(cells[k].header, F.col(f"_t{k}")).alias(f"_g{k}") for k in asked))
        step = step.select("*", *(e164(F.col(f"_g{k}"), region).alias(f"_h{k}") for k in asked))
        if custom:
            step = step.select("*", *(_by_strategies(valued, cells[k].header, F.col(f"_c{k}"), region).alias(f"_u{k}") for k in asked))
            passed = [F.when(F.col(f"_u{k}.confidence") >= floor, F.col(f"_u{k}.canonical")).alias(f"_s{k}") for k in asked]
        else:
            passed = [shape_column(cells[k].header, F.col(f"_t{k}"), F.col(f"_h{k}")).alias(f"_s{k}") for k in asked]
        step = step.select("*", *passed)
        texts = [k for k, f in static.items() if normalize and cells[k].kind == "string" and f not in (*PHONE_FIELDS, *NAME_FIELDS)]
        step = step.select("*", *(base_text(static[k], F.col(f"_c{k}")).alias(f"_b{k}") for k in texts))
        parts = [k for k in texts if static[k] in (*DATE_FIELDS, *LIST_FIELDS)]
        step = step.select("*", *(base_parts(static[k], F.col(f"_b{k}")).alias(f"_q{k}") for k in parts))
        values = [self._value(cells[k], F.col(f"_c{k}"), f, normalize, region, F.col(f"_b{k}") if k in texts else None, F.col(f"_q{k}") if k in parts else None).alias(f"_v{k}") for k, f in static.items()]
        if custom or floor <= SHAPE:
            values += [self._shaped_value(cells[k], k, normalize, more, region).alias(f"_v{k}") for k in asked]
        step = step.select("*", *values)

        # Fields that only headers decide are merged from their own cells; others from entries by row.
        shaped = {f for k in asked for f in (*reachable(cells[k].header), *more)} if custom or floor <= SHAPE else set()
        shaped |= {"phone"} if embedded else set()
        matches, unmapped, warnings, entries, texts = [], [], [], [], []
        own: dict[str, list[tuple[int, Column | None, Column]]] = {}
        hits, present = [], []
        for k, cell in enumerate(cells):
            there = F.lit(True) if cell.present is None else F.col(f"_p{k}")
            head, none = F.lit(cell.header), F.lit(None).cast("string")
            raw = F.to_json(f"_c{k}") if cell.kind == "array" else F.col(f"_c{k}")
            canonical, confidence, strategy, hit = F.lit(UNKNOWN), F.lit(0.0), F.lit("none"), F.lit(False)
            if k in static:
                canonical, confidence, strategy, hit = F.lit(static[k]), F.lit(cell.match.confidence), F.lit(cell.match.strategy), F.lit(True)
                w = None if static[k] in LIST_FIELDS else value_warning(cell.header, static[k], F.get(F.col(f"_v{k}"), F.lit(0)))
                warnings += [] if w is None else [F.when(there, w)]
                if cell.kind == "string" and static[k] not in (*PHONE_FIELDS, *LIST_FIELDS):
                    texts.append((1, static[k], F.get(F.col(f"_v{k}"), F.lit(0))))
            elif k in asked and (custom or floor <= SHAPE):
                shape = F.col(f"_s{k}")
                hit = shape.isNotNull()
                sure, by = (F.col(f"_u{k}.confidence"), F.col(f"_u{k}.strategy")) if custom else (F.lit(SHAPE), F.lit("heuristic"))
                canonical, confidence, strategy = F.coalesce(shape, F.lit(UNKNOWN)), F.when(hit, sure).otherwise(0.0), F.when(hit, by).otherwise("none")
                if "birthday" in reachable(cell.header):
                    warnings.append(F.when(there & (shape == "birthday"), value_warning(cell.header, "birthday", F.get(F.col(f"_v{k}"), F.lit(0)))))
                texts.append((0, cell.header, F.when(shape.isNull(), F.col(f"_c{k}"))))
            else:
                if cell.match is not None and cell.match.canonical != UNKNOWN:  # an unknown verdict is one that a plan froze
                    warnings.append(F.when(there, warning(WarningCategory.LOW_CONFIDENCE, F.lit(self._low(cell.match, floor)), cell.header)))
                elif k in asked:
                    low = F.concat(F.lit(f"{cell.header!r}: dropped low-confidence match to '"), F.col(f"_s{k}"), F.lit(f"' (confidence {SHAPE:.2f} < threshold {floor:.2f})"))
                    warnings.append(F.when(there & F.col(f"_s{k}").isNotNull(), warning(WarningCategory.LOW_CONFIDENCE, low, cell.header)))
                if cell.kind == "string":
                    texts.append((0, cell.header, F.col(f"_c{k}")))
            found = F.struct(head.alias("original"), canonical.alias("canonical"), confidence.alias("confidence"), strategy.alias("strategy"), none.alias("service"))
            matches.append(F.when(there, found) if cell.present is not None else found)
            present.append(F.lit(1) if cell.present is None else there.cast("int"))
            if k not in static:
                unmapped.append(F.when(there & ~hit, F.struct(head.alias("key"), raw.alias("value"))))
            if k in static or (k in asked and (custom or floor <= SHAPE)):
                hits.append((there & hit).cast("int"))
                if k in static and static[k] not in shaped and not (custom and asked):
                    own.setdefault(static[k], []).append((k, None if cell.present is None else there, F.col(f"_v{k}")))
                else:
                    entries.append(F.when(there & hit, F.struct(F.lit(k).alias("pos"), canonical.alias("field"), F.col(f"_v{k}").alias("values"))))
        if embedded:
            step, more = self._embed(step, texts, region)
            extra = F.array_distinct(F.transform("_extra", lambda x: x["e164"]))
            entries.append(F.when(F.size("_extra") > 0, F.struct(F.lit(len(cells)).alias("pos"), F.lit("phone").alias("field"), extra.alias("values"))))
            warnings += more
            hits.append(F.size("_extra"))
            present.append(F.size("_extra"))
        sums = [reduce(Column.__add__, x, F.lit(0)).alias(name) for x, name in ((hits, "matched"), (present, "_cells"))]
        step = step.select(*kept, *(["_extra"] if embedded else []), *sums, _merged(own, entries).alias("_merged"), F.map_from_entries(_array(unmapped, PAIR)).alias("unmapped"), _array(matches, MATCH).alias("field_matches"), _array(warnings, WARNING).alias("warnings"))
        found = F.col("field_matches")
        if embedded:
            found = F.concat(found, F.transform("_extra", lambda x: F.struct(x["header"].alias("original"), F.lit("phone").alias("canonical"), F.lit(SHAPE).alias("confidence"), F.lit("embedded_phone").alias("strategy"), F.lit(None).cast("string").alias("service"))))
        merged = F.map_from_entries("_merged") if not entries else F.map_from_entries(F.transform(F.sort_array("_merged"), lambda x: F.struct(x["key"], x["value"])))
        step = step.select(*kept, merged.alias("normalized"), "unmapped", found.alias("field_matches"), "warnings", "matched", (F.col("_cells") - F.col("matched")).alias("unmatched"))
        total = F.col("matched") + F.col("unmatched")
        rate = F.when(total > 0, F.col("matched") / total).otherwise(0.0)
        possible = None if custom and asked else {*own, *shaped, *static.values()}
        return step.select("*", rate.alias("match_rate"), identity_keys(F.col("normalized"), possible).alias("identity_keys"))

    @staticmethod
    def _value(cell: Cell, c: Column, field: str, normalize: bool, region: str | None, text: Column | None = None, parts: Column | None = None) -> Column:
        if cell.kind == "array":
            if field in LIST_FIELDS:
                return F.filter(F.transform(c, trim), lambda x: x != "") if normalize else c
            return F.array(F.to_json(c))
        if not normalize or cell.kind in ("scalar", "object"):
            return F.array(c)
        made = normalize_column(field, c, region, text, parts)
        return made if field in LIST_FIELDS else F.array(made)

    @staticmethod
    def _shaped_value(cell: Cell, k: int, normalize: bool, more: tuple[str, ...], region: str | None) -> Column:
        c, shape, text = F.col(f"_c{k}"), F.col(f"_s{k}"), F.col(f"_t{k}")
        if not normalize or cell.kind == "scalar":
            return F.array(c)
        made = F.when(shape == "email", F.lower(text)).when(shape == "phone", F.col(f"_h{k}")).when(shape == "postal_code", normalize_column("postal_code", text))
        if "birthday" in reachable(cell.header):
            made = made.when(shape == "birthday", normalize_column("birthday", c))
        for f in more:
            if f not in LIST_FIELDS:
                made = made.when(shape == f, normalize_column(f, F.when(shape == f, c), region))
        one = F.array(made.otherwise(text))
        lists = [f for f in more if f in LIST_FIELDS]
        return F.when(shape.isin(*lists), normalize_column(lists[0], c)).otherwise(one) if lists else one

    @staticmethod
    def _embed(step: DataFrame, texts: list[tuple[int, str, Column]], region: str | None) -> tuple[DataFrame, list[Column]]:
        """Adds ``_extra``, the numbers inside texts: unmapped cells first, then normalised fields that are no phones."""
        texts = sorted(texts, key=lambda x: x[0])
        step = step.select("*", *(c.alias(f"_x{n}") for n, (_, _, c) in enumerate(texts)))
        step = step.select("*", *(embedded_numbers(F.col(f"_x{n}"), region, longest=EMBEDDED_TEXT).alias(f"_e{n}") for n in range(len(texts))))
        if not texts:
            return step.select("*", F.array().cast("array<struct<header:string,e164:string>>").alias("_extra")), []
        none = F.array().cast("array<struct<start:int,end:int,raw:string,e164:string>>")
        seen = [F.struct(F.coalesce(F.length(f"_x{n}"), F.lit(0)).alias("size"), F.size(F.coalesce(F.col(f"_e{n}"), none)).alias("n")) for n in range(len(texts))]
        step = step.select("*", F.array(*seen).alias("_seen"))

        def limits(x: Column, i: Column) -> Column:
            """What fields before took of the row's limit, and what is left for this one."""
            taken = F.aggregate(F.slice(F.col("_seen"), F.lit(1), i), F.lit(0), lambda t, y: t + F.least(F.lit(EMBEDDED_PER_FIELD), y["n"]))
            before = F.least(F.lit(EMBEDDED_PER_ROW), taken)
            left = F.least(F.lit(EMBEDDED_PER_FIELD), EMBEDDED_PER_ROW - before)
            return F.struct(x["size"].alias("size"), x["n"].alias("n"), left.alias("left"), (before + F.least(left, x["n"])).alias("after"))

        step = step.select("*", F.transform("_seen", limits).alias("_limits"))
        parts, caps = [], []
        for n, (_, header, _) in enumerate(texts):
            x = F.get(F.col("_limits"), F.lit(n))
            parts.append(F.transform(F.slice(F.coalesce(F.col(f"_e{n}"), none), F.lit(1), x["left"]), _under(header)))
            long = f"{header!r}: embedded phone scan truncated at {EMBEDDED_TEXT} characters"
            many = f"{header!r}: embedded phone extraction stopped after {EMBEDDED_PER_FIELD} matches for this field"
            caps.append(F.when((x["left"] > 0) & (x["size"] > EMBEDDED_TEXT), warning(WarningCategory.EMBEDDED_PHONE_LIMIT, F.lit(long), header)))
            caps.append(F.when((x["left"] == EMBEDDED_PER_FIELD) & (x["n"] > EMBEDDED_PER_FIELD), warning(WarningCategory.EMBEDDED_PHONE_LIMIT, F.lit(many), header)))
        full = F.exists("_limits", lambda x: ((x["left"] == 0) & (x["size"] > 6)) | ((x["n"] > x["left"]) & (x["after"] >= EMBEDDED_PER_ROW)))
        row = f"embedded phone extraction stopped after {EMBEDDED_PER_ROW} matches for this payload"
        caps.append(F.when(full, warning(WarningCategory.EMBEDDED_PHONE_LIMIT, F.lit(row), "")))
        return step.select("*", F.flatten(F.array(*parts)).alias("_extra")), caps

    # Aggregates

    def profile(self, df: DataFrame, *, max_rows: int | None = None, normalize: bool = True, **options: Any) -> DataFrame:
        """One row of counts over the mapped rows of ``df``; ``max_rows`` takes so many rows of it."""
        return profile_results(self.map(_first(df, max_rows), normalize=normalize, **options))


def _first(df: DataFrame, max_rows: int | None) -> DataFrame:
    if max_rows is None:
        return df
    if isinstance(max_rows, bool) or not isinstance(max_rows, int):
        raise TypeError("max_rows must be a whole number")
    if max_rows < 0:
        raise ValueError("max_rows must not be negative")
    return df.limit(max_rows)


def _by_strategies(strategies: list[Strategy], header: str, c: Column, region: str | None) -> Column:
    """STRUCT<canonical, confidence, strategy> of the first value-dependent strategy that matches."""

    @F.pandas_udf("canonical string, confidence double, strategy string")
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            found = [next((m for s in strategies if (m := s.match(header, v, default_region=region)) is not None), None) for v in column]
            rows = [(None, None, None) if m is None else (m.canonical, m.confidence, m.strategy) for m in found]
            yield pd.DataFrame(rows, columns=["canonical", "confidence", "strategy"]).astype({"confidence": "float64"})

    return verdicts(c)


def _under(header: str) -> Any:
    """Lambda: a found number with the header it stands under."""
    return lambda x: F.struct(F.lit(header).alias("header"), x["e164"].alias("e164"))


def _array(items: list[Column], kind: str) -> Column:
    """The items that are not null, in order, as ARRAY of ``kind``."""
    return F.array_compact(F.array(*items)) if items else F.array().cast(f"array<{kind}>")


def _let(value: Column, body: Any) -> Column:
    """``body(value)``, computing the value once for all its uses in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merge(field: Column, own: Column) -> Column:
    """Values of one field from its (values) entries in column order.

    List fields are the first list as it is and then what later ones add; other fields hold their
    distinct non-blank values, or the first value where all are blank.
    """
    every = F.flatten(F.transform(own, lambda e: F.coalesce(e["values"], F.array().cast("array<string>"))))
    first = F.get(own, F.lit(0))["values"]

    def pick(every: Column) -> Column:
        good = F.array_distinct(F.filter(every, lambda x: ~_blank(x)))
        lead = F.coalesce(F.get(F.filter(own, lambda e: F.size(e["values"]) > 0), F.lit(0))["values"], F.array().cast("array<string>"))
        flat = F.concat(lead, F.array_except(F.array_distinct(every), lead))
        return F.when(F.size(own) == 1, first).when(field.isin(*LIST_FIELDS), flat).when(F.size(good) > 0, good).otherwise(first)

    return _let(every, pick)


def merged_entries(entries: Column) -> Column:
    """ARRAY<STRUCT<pos, key, value>> of (pos, field, values) entries in column order; ``pos`` is that
    of a field's first entry."""

    def of_field(entries: Column) -> Column:
        fields = F.array_distinct(F.transform(entries, lambda e: e["field"]))

        def made(f: Column) -> Column:
            return _let(F.filter(entries, lambda e: e["field"] == f), lambda own: F.struct(F.get(own, F.lit(0))["pos"].alias("pos"), f.alias("key"), _merge(f, own).alias("value")))

        return F.filter(F.transform(fields, made), lambda x: x["value"].isNotNull())

    return _let(entries, of_field)


def _merge_any(field: str) -> Any:
    """Lambda: the merged values of entries, null without any."""
    return lambda own: F.when(F.size(own) > 0, _merge(F.lit(field), own))


def _merged(own: dict[str, list[tuple[int, Column | None, Column]]], entries: list[Column]) -> Column:
    """The merged fields of a row: (key, value), with ``pos`` before them where ``entries`` of fields
    that depend on values stand beside the ``own`` cells (place, presence, values) of others."""
    made = []
    for field, cells in own.items():
        if len(cells) == 1:
            [(pos, there, value)] = cells
            value, at = value if there is None else F.when(there, value), F.lit(pos)
        else:
            each = [F.struct(F.lit(k).alias("pos"), v.alias("values")) if there is None else F.when(there, F.struct(F.lit(k).alias("pos"), v.alias("values"))) for k, there, v in cells]
            value = _let(F.array_compact(F.array(*each)), _merge_any(field))
            at = F.get(F.array_compact(F.array(*each)), F.lit(0))["pos"]
        pair = [F.lit(field).alias("key"), value.alias("value")]
        made.append(F.when(value.isNotNull(), F.struct(at.alias("pos"), *pair) if entries else F.struct(*pair)))
    known = _array(made, MERGED if entries else MERGED.replace("pos:int,", ""))
    return F.concat(known, merged_entries(_array(entries, ENTRY))) if entries else known


def values_of(normalized: Column, field: str) -> Column:
    """Values of a field, empty where it is absent."""
    return F.coalesce(normalized[field], F.array().cast("array<string>"))


def all_phones(normalized: Column, fields: Sequence[str] = PHONE_FIELDS) -> Column:
    """Values of the five phone fields in their order, distinct, blanks dropped."""
    return F.array_distinct(F.filter(F.flatten(F.array(*(values_of(normalized, f) for f in fields))), lambda x: ~_blank(x)))


def all_emails(normalized: Column) -> Column:
    return F.array_distinct(F.filter(values_of(normalized, "email"), lambda x: ~_blank(x)))


def identity_keys(normalized: Column, possible: set[str] | None = None) -> Column:
    """Prefixed distinct keys: e-mails, phones, source ids (under their service if it is one).
    ``possible`` are the only fields that rows can have, where that is known."""
    there = lambda f: possible is None or f in possible
    parts = []
    if there("email"):
        parts.append(F.transform(all_emails(normalized), lambda x: F.concat(F.lit("email:"), F.lower(trim(x)))))
    if phones := [f for f in PHONE_FIELDS if there(f)]:
        parts.append(F.transform(all_phones(normalized, phones), lambda x: F.concat(F.lit("phone:"), trim(x))))
    if there("source_id"):
        services = F.filter(values_of(normalized, "source_service"), lambda x: ~_blank(x))
        prefix = F.when(F.size(services) == 1, F.concat(F.lit("source:"), F.lower(trim(F.get(services, F.lit(0)))), F.lit(":"))).otherwise(F.lit("source_id:"))
        parts.append(F.transform(F.filter(values_of(normalized, "source_id"), lambda x: ~_blank(x)), lambda x: F.concat(prefix, trim(x))))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def get_match(header: str) -> Column:
    """The last verdict of a header in ``field_matches``, null where it has none."""
    return F.try_element_at(F.filter("field_matches", lambda m: m["original"] == header), F.lit(-1))


def _count_map(kind: str) -> Column:
    own = F.filter(F.collect_list(F.struct("kind", "name", "n")), lambda x: x["kind"] == kind)
    return F.map_from_entries(F.transform(F.sort_array(own), lambda x: F.struct(x["name"], x["n"])))


def _profile_rows(results: DataFrame) -> DataFrame:
    """(kind, name, n) in one pass over the results: of field matches by strategy and by canonical
    field or unmapped header, of warnings by category, and of rows."""

    def of_match(m: Column) -> Column:
        known = m["canonical"] != UNKNOWN
        field = F.struct(F.when(known, "canonical").otherwise("unmapped").alias("kind"), F.when(known, m["canonical"]).otherwise(m["original"]).alias("name"))
        return F.array(F.struct(F.lit("strategy").alias("kind"), m["strategy"].alias("name")), field)

    of_warning = lambda w: F.struct(F.lit("warning").alias("kind"), w["category"].alias("name"))
    row = F.array(F.struct(F.lit("row").alias("kind"), F.lit("").alias("name")))
    every = F.concat(row, F.flatten(F.transform("field_matches", of_match)), F.transform("warnings", of_warning))
    return results.select(F.explode(every).alias("x")).groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def profile_counts(results: DataFrame) -> DataFrame:
    """(kind, name, n): counts by canonical field, unmapped header, strategy and warning category."""
    return _profile_rows(results).where("kind <> 'row'")


def profile_results(results: DataFrame) -> DataFrame:
    """One row: totals and the four count maps, from one pass."""
    counts = _profile_rows(results)
    sums = {"rows_seen": "row", "fields_seen": "strategy", "matched": "canonical", "unmatched": "unmapped", "warning_count": "warning"}
    totals = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name) for name, kind in sums.items()]
    maps = [_count_map(kind).alias(f"{kind}_counts") for kind in ("canonical", "unmapped", "strategy", "warning")]
    row = counts.agg(*totals, *maps)
    rate = F.when(F.col("fields_seen") > 0, F.col("matched") / F.col("fields_seen")).otherwise(0.0)
    return row.select(*sums, *(f"{kind}_counts" for kind in ("canonical", "unmapped", "strategy", "warning")), rate.alias("match_rate"))


def json_headers(df: DataFrame, column: str, depth: int = 1, most: int = 10_000) -> list[str]:
    """Distinct keys of the JSON objects, in order of first appearance by name; nested to ``depth``.
    More than ``most`` at a level are an error: each is a column of the plan."""
    found: list[str] = []
    level = df.select(F.lit("").alias("path"), F.col(_quote(column)).alias("doc"))
    for n in range(max(1, min(MAX_DEPTH, depth))):
        deeper = n + 1 < min(MAX_DEPTH, depth)
        keyed = level.select("path", "doc", F.posexplode(F.json_object_keys("doc")).alias("pos", "key"))
        nested = F.max(F.json_object_keys(_at("doc", "key")).isNotNull()) if deeper else F.lit(False)
        rows = keyed.groupBy("path", "key").agg(F.min("pos").alias("pos"), nested.alias("nested")).orderBy("pos", "path", "key").limit(most + 1).collect()
        if len(rows) > most:
            raise ContactError(f"the rows hold more than {most} different keys; name the headers to map")
        found += [f"{r['path']}{r['key']}" for r in rows if not r["nested"]]
        if not any(r["nested"] for r in rows):
            break
        level = keyed.select(F.concat("path", "key", F.lit(".")).alias("path"), _at("doc", "key").alias("doc")).where("doc is not null")
    return list(dict.fromkeys(found))


def _at(doc: str, key: str) -> Column:
    return F.call_function("get_json_object", F.col(doc), F.concat(F.lit("$['"), F.col(key), F.lit("']")))

