"""A reusable header plan that can be saved as JSON and replayed."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

from ..fields import UNKNOWN, VocabularyError
from ..headers import FieldMatch

if TYPE_CHECKING:
    from ..operators.mapper import ContactMapper

SCHEMA_VERSION = 1


@dataclass
class MappingPlan:
    """Header verdicts in column order, and the region they were made for."""

    matches: dict[str, FieldMatch]
    mapper: ContactMapper
    default_region: str | None = None

    def column_map(self) -> dict[str, str]:
        """header -> canonical field of the matched headers."""
        return {h: m.canonical for h, m in self.matches.items() if m.canonical != UNKNOWN}

    def unmatched_headers(self) -> list[str]:
        return [h for h, m in self.matches.items() if m.canonical == UNKNOWN]

    def apply(self, df: DataFrame, **options: Any) -> DataFrame:
        """Full row mapping of ``df`` under this plan."""
        options.setdefault("default_region", self.default_region)
        return self.mapper.map(df, **options)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The plan as a dimension table."""
        rows = [(h, m.canonical, m.confidence, m.strategy, m.service) for h, m in self.matches.items()]
        return spark.createDataFrame(rows, "header string, canonical string, confidence double, strategy string, service string")

    def to_dict(self) -> dict[str, Any]:
        columns = {h: {"canonical": m.canonical, "confidence": m.confidence, "strategy": m.strategy, "service": m.service} for h, m in self.matches.items()}
        return {"schema_version": SCHEMA_VERSION, "default_region": self.default_region, "columns": columns}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any], mapper: ContactMapper, default_region: str | None = None, freeze_unknown: bool = False) -> MappingPlan:
        """Check a saved plan and seed the mapper with it; its verdicts are never evicted."""
        if not isinstance(data, Mapping) or data.get("schema_version") != SCHEMA_VERSION:
            raise VocabularyError(f"a saved plan needs schema_version {SCHEMA_VERSION}")
        if not isinstance(data.get("columns"), Mapping):
            raise VocabularyError("a saved plan needs an object 'columns'")
        region = default_region or data.get("default_region")
        if region is not None and not isinstance(region, str):
            raise VocabularyError("default_region must be text")
        known = {*mapper.registry.canonical_fields, UNKNOWN}
        matches = {}
        for header, m in data["columns"].items():
            if not isinstance(m, Mapping):
                raise VocabularyError(f"column {header!r} must be an object")
            canonical, confidence, strategy = m.get("canonical"), m.get("confidence"), m.get("strategy")
            if canonical not in known:
                raise VocabularyError(f"column {header!r}: unknown canonical field {canonical!r}")
            if not isinstance(strategy, str) or not strategy:
                raise VocabularyError(f"column {header!r}: needs a strategy")
            if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
                raise VocabularyError(f"column {header!r}: confidence must be between 0 and 1")
            matches[header] = FieldMatch(header, canonical, float(confidence), strategy, m.get("service"))
        mapper.resolver.seed(list(matches.values()), freeze_unknown)
        return cls(matches, mapper, region)

    @classmethod
    def load(cls, path: str | Path, mapper: ContactMapper, **options: Any) -> MappingPlan:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as error:
            raise VocabularyError(f"cannot read the plan {path}: {error}") from error
        return cls.from_dict(data, mapper, **options)
