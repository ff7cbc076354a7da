"""Contact-record schema mapping and value normalisation as Spark plans.

Exports are loaded on demand, so that workers import only what a function needs.
"""

from __future__ import annotations

import importlib

_EXPORTS = {
    "contactloom.operators.mapper": ["ContactMapper", "all_emails", "all_phones", "get_match", "identity_keys", "profile_counts", "profile_results"],
    "contactloom.operators.dedupe": ["dedupe", "dedupe_single"],
    "contactloom.plans.mapping": ["MappingPlan"],
    "contactloom.aliases": ["AliasRegistry"],
    "contactloom.fields": ["CanonicalField", "ContactError", "NormalizationError", "VocabularyError", "WarningCategory"],
    "contactloom.headers": ["ExactStrategy", "FieldMatch", "FuzzyStrategy", "NormalizedStrategy", "ShapeStrategy", "Strategy"],
    "contactloom.functions.values": ["boolean_value", "normalize_column", "value_warning"],
    "contactloom.functions.names": ["name_parts", "normalize_name", "person_name", "split_name"],
    "contactloom.functions.phones": ["MatchType", "NumberType", "PhoneNumber", "PhoneNumberMatch", "PhoneNumberMatcher", "format_e164", "format_international", "format_national", "is_number_match", "is_valid", "number_type", "parse", "phone_struct"],
    "contactloom.i18n": ["LANGUAGES", "generate_language"],
    "contactloom.sources.readers": ["read_rows"],
    "contactloom.sources.writers": ["write_results"],
    "contactloom.sql": ["register_functions"],
    "contactloom.operators.reports": ["explain_profile", "explain_result", "profile_dict", "result_json", "run_stats"],
    "contactloom.operators.header_tables": ["resolve_headers"],
    "contactloom.streaming": ["dedupe_stream", "map_stream", "profile_stream", "quarantine_stream"],
    "contactloom.storage": ["release"],
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    if name in _HOME:
        return getattr(importlib.import_module(_HOME[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return __all__
