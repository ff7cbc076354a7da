"""The fixed vocabulary of contact fields, their value groups, warnings and errors."""

from __future__ import annotations

from enum import Enum

# The canonical fields and the groups that share a normaliser.
PHONE_FIELDS = ("phone", "home_phone", "work_phone", "fax", "whatsapp")
NAME_FIELDS = ("first_name", "last_name", "full_name", "middle_name", "prefix", "suffix", "nickname")
ADDRESS_FIELDS = ("address_line1", "address_line2", "city", "full_address")
BOOLEAN_FIELDS = ("email_opt_out", "subscribed", "verified")
LIST_FIELDS = ("tags",)
DATE_FIELDS = ("birthday", "created_at", "updated_at", "last_contacted")
SOCIAL_FIELDS = ("website", "linkedin", "twitter", "facebook", "instagram", "github", "youtube", "tiktok", "discord", "telegram")
PLAIN_FIELDS = (
    "company job_title department industry gender timezone language_preference referrer_url lead_status lifecycle_stage source"
    " utm_parameters age notes message subject company_size revenue currency score owner metadata source_id source_service"
).split()
ALL_FIELDS = (*NAME_FIELDS, "email", *PHONE_FIELDS, *ADDRESS_FIELDS, "state", "postal_code", "country", *SOCIAL_FIELDS, *BOOLEAN_FIELDS, *LIST_FIELDS, *DATE_FIELDS, *PLAIN_FIELDS)
VALUE_BEARING = frozenset((*PHONE_FIELDS, *SOCIAL_FIELDS, "email"))
UNKNOWN = "unknown"

CanonicalField = Enum("CanonicalField", {f.upper(): f for f in (*ALL_FIELDS, UNKNOWN)}, type=str)

# Confidences and limits.
EXACT, NORMALIZED, FUZZY_HIGH, FUZZY_LOW, SHAPE = 1.0, 0.95, 0.85, 0.70, 0.60
FUZZY_CUTOFF, FUZZY_HIGH_SCORE, FUZZY_RATIO = 80.0, 90.0, 0.5
EMBEDDED_TEXT, EMBEDDED_PER_FIELD, EMBEDDED_PER_ROW = 8192, 5, 20
SHAPE_LENGTH, HEADER_CACHE, MAX_DEPTH = 512, 4096, 5


class WarningCategory(str, Enum):
    """What a warning is about."""

    LOW_CONFIDENCE = "low_confidence"
    PHONE_NORMALIZATION = "phone_normalization"
    EMAIL_VALIDATION = "email_validation"
    EMBEDDED_PHONE_LIMIT = "embedded_phone_limit"
    DATE_AMBIGUOUS = "date_ambiguous"
    OTHER = "other"


class ContactError(Exception):
    """Any error of this library."""


class VocabularyError(ContactError):
    """An alias table, language pack or saved plan that cannot be used."""


class NormalizationError(ContactError):
    """Strict mode met a warning."""
