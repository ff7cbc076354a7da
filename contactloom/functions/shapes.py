"""Value-shape detection: an ordered list of patterns, the first accepted one wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fields import SHAPE_LENGTH
from ..headers import hints

# Social hosts and the paths of profiles there.
SOCIAL_SHAPES = (
    ("linkedin", r"linkedin\.com", r"(in|company|pub|school)/"),
    ("twitter", r"twitter\.com|x\.com", r"[a-zA-Z0-9_]+/?$"),
    ("instagram", r"instagram\.com", r"[a-zA-Z0-9_.]+/?$"),
    ("github", r"github\.com", r"[a-zA-Z0-9\-]+/?$"),
    ("facebook", r"facebook\.com|fb\.com", r"[a-zA-Z0-9.]+/?$"),
    ("youtube", r"youtube\.com", r"((channel|c)/[a-zA-Z0-9\-_]+|@[a-zA-Z0-9\-_]+)/?$"),
    ("tiktok", r"tiktok\.com", r"@[a-zA-Z0-9_.]+/?$"),
)
# Fixed values: (field, guard, pattern) in order; a guard names what must hold besides the pattern.
SHAPES: tuple[tuple[str, str, str], ...] = (
    ("email", "", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"),
    ("phone", "phone", r"^\+?1?\s*[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"),
    ("phone", "phone", r"^\+?[1-9]\d{6,14}$"),
    *((field, "", rf"(?i)^https?://(www\.)?({host})/{path}") for field, host, path in SOCIAL_SHAPES),
    ("website", "", r"(?i)^https?://[^\s]+$"),
    ("website", "", r"(?i)^www\.[^\s]+\.[a-zA-Z]{2,}$"),
    ("twitter", "", r"^@[a-zA-Z0-9_]{1,15}$"),
    ("postal_code", "postal", r"^\d{5}(-\d{4})?$"),
    ("postal_code", "", r"(?i)^[A-Z]\d[A-Z]\s?\d[A-Z]\d$"),
    ("postal_code", "", r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$"),
    ("birthday", "birthday", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"),
    ("birthday", "birthday", r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"),
    ("birthday", "birthday", r"^\d{1,2}\.\d{1,2}\.\d{2,4}$"),
)
SHAPE_FIELDS = tuple(dict.fromkeys(field for field, _, _ in SHAPES))


def shape_of(header: str, value: object, region: str = "US") -> str | None:
    """The shape of one value, for single look-ups on the driver."""
    if value is None or isinstance(value, (list, tuple, dict, set)):
        return None
    text, hinted = str(value).strip(), hints(header)
    if not text or len(text) > SHAPE_LENGTH:
        return None
    for field, guard, pattern in SHAPES:
        if not re.search(pattern, text):
            continue
        if guard == "phone":
            from .phones import parse

            if (text.isdigit() and "phone" not in hinted) or parse(text, region) is None:
                continue
        elif guard == "postal" and re.fullmatch(r"\d{5}", text) and "postal" not in hinted:
            continue
        elif guard == "birthday" and "birthday" not in hinted:
            continue
        return field
    return None


def reachable(header: str) -> list[str]:
    """Fields that a value under this header can be taken for."""
    return [f for f in SHAPE_FIELDS if f != "birthday" or "birthday" in hints(header)]


def phone_candidate(header: str, text: Column) -> Column:
    """The stripped value where a phone pattern and the header allow a number, for the parser."""
    test = F.lit(False)
    for _, guard, pattern in SHAPES:
        if guard == "phone":
            test = test | text.rlike(pattern)
    if "phone" not in hints(header):
        test = test & ~text.rlike(r"^\d+$")
    return F.when(test & F.length(text).between(1, SHAPE_LENGTH), text)


def shape_column(header: str, text: Column, phone: Column) -> Column:
    """The canonical field that the shape of a stripped value names, or null.  Header hints are
    settled now; ``phone`` is what the parser made of :func:`phone_candidate`."""
    hinted, chain, done = hints(header), None, False
    for field, guard, pattern in SHAPES:
        if guard == "phone":
            if done:
                continue
            test, done = phone.isNotNull(), True
        elif guard == "birthday" and "birthday" not in hinted:
            continue
        else:
            test = text.rlike(pattern)
        if guard == "postal" and "postal" not in hinted:
            test = test & ~text.rlike(r"^\d{5}$")
        chain = F.when(test, field) if chain is None else chain.when(test, field)
    # Every pattern needs one of these, so plain words are tested once.
    return F.when(F.length(text).between(1, SHAPE_LENGTH) & text.rlike(r"(?i)[@\d]|http|www"), chain)
