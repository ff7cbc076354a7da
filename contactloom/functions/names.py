"""Person names: casing with particles, titles and suffixes, and the split into parts.

Casing needs the structure of the whole name, so it is an Arrow UDF over distinct work: blank and
null values never reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of names with a case of their own.
PARTICLES = frozenset(
    "abu al bin bon da dal de de' degli dei del dela della delle delli dello den der di do dos du e ibn la le mac mc san santa st ste van vel vom von y ten ter zur zum das des op el".split()
)
TITLES = frozenset(
    "dr mr mrs ms mx miss prof professor sir dame madam lord lady rev reverend fr father sister brother hon honorable capt captain col colonel gen general lt lieutenant maj major sgt sergeant cpl pvt adm admiral cmdr"
    " president judge justice rabbi imam sheikh king queen prince princess duke duchess baron baroness count countess gov governor sen senator rep amb ambassador his her excellency majesty highness the mr. dr.".split()
)
SUFFIXES = frozenset("jr sr ii iii iv v esq esquire phd md dds dvm cpa mba jd rn obe mbe cbe".split())
SPECIAL = {"phd": "Ph.D.", "md": "M.D.", "ii": "II", "iii": "III", "iv": "IV"}
CONJUNCTIONS = frozenset("and & of the und y e".split())
_MAC = re.compile(r"^(ma?c)(\w{2,})$")
_NICK = re.compile(r"\"([^\"]*)\"|\(([^)]*)\)|(?<!\w)'([^']*)'(?!\w)")


def _bare(word: str) -> str:
    return word.lower().rstrip(".").replace(".", "")


def _cased(word: str, first: bool = False) -> str:
    low = word.lower()
    if low in PARTICLES and not first or low in CONJUNCTIONS:
        return low
    if low in SPECIAL:
        return SPECIAL[low]

    def part(p: str) -> str:
        if m := _MAC.match(p):
            return m[1].capitalize() + m[2].capitalize()
        for k, c in enumerate(p):
            if c.isalpha():
                return p[:k] + c.upper() + p[k + 1 :]
        return p

    return re.sub(r"[^-']+", lambda m: part(m[0]), low)


@lru_cache(maxsize=50_000)
def split_name(value: str) -> tuple[str, str, str, str, str, str]:
    """(title, first, middle, last, suffix, nickname) of a name, in the spelling given."""
    nicknames = [next(x for x in m.groups() if x is not None).strip() for m in _NICK.finditer(value)]
    text = " ".join(_NICK.sub(" ", value).split())
    sections = [s.split() for s in text.split(",")]
    sections = [s for s in sections if s]
    suffix: list[str] = []
    while len(sections) > 1 and all(_bare(w) in SUFFIXES for w in sections[-1]):
        suffix = sections.pop() + suffix
    words: list[str]
    if len(sections) > 1:  # family name first
        family, given = sections[0], [w for s in sections[1:] for w in s]
        while len(family) > 1 and _bare(family[-1]) in SUFFIXES:
            suffix = [family.pop(), *suffix]
        words, last_size = given, len(family)
    else:
        family, words, last_size = [], sections[0] if sections else [], 0
    while len(words) > 1 and _bare(words[-1]) in SUFFIXES and not (_bare(words[-1]) == "v" and len(words) <= 2):
        suffix = [words.pop(), *suffix]
    title: list[str] = []
    while len(words) > (0 if last_size else 1) and (_bare(words[0]) in TITLES or (title and words[0].lower() in CONJUNCTIONS)):
        title.append(words.pop(0))
    words += family
    if not words:
        return " ".join(title), "", "", "", " ".join(suffix), " ".join(nicknames)
    if last_size:
        first, middle, last = words[: len(words) - last_size][:1], words[1 : len(words) - last_size], words[len(words) - last_size :]
        if len(words) == last_size:
            first, middle, last = [], [], words
    elif len(words) == 1:
        first, middle, last = ([], [], words) if title else (words, [], [])
    else:
        start = len(words) - 1
        while start > 1 and words[start - 1].lower() in PARTICLES:
            start -= 1
        first, middle, last = words[:1], words[1:start], words[start:]
    return " ".join(title), " ".join(first), " ".join(middle), " ".join(last), " ".join(suffix), " ".join(nicknames)


@lru_cache(maxsize=50_000)
def normalize_name(value: str) -> str:
    """The name in conventional case; blank values as they are."""
    text = " ".join(value.split())
    if not text:
        return value
    title, first, middle, last, suffix, nickname = split_name(text.lower())
    words = " ".join(x for x in (first, middle, last) if x).split()
    out = [_cased(w) for w in title.split()]
    out += [_cased(w) for w in words]
    out += [_cased(w) for w in suffix.split()]
    made = " ".join(out)
    if nickname:
        made = f"{made} ({nickname})" if made else f"({nickname})"
    if not title or made[:1].isupper():
        return made[:1].upper() + made[1:] if made else text
    return made


def person_name(c: Column) -> Column:
    """Normalised name; null and blank values pass through."""

    @F.pandas_udf("string")
    def cased(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield pd.Series([None if n is None else normalize_name(n) for n in names], dtype=object)

    return F.coalesce(cased(F.when(c.rlike(r"(?U)\S"), c)), c)


def name_parts(c: Column) -> Column:
    """STRUCT<title, first, middle, last, suffix, nickname> of a name."""

    @F.pandas_udf("title string, first string, middle string, last string, suffix string, nickname string")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for names in batches:
            rows = [split_name("" if n is None else n) for n in names]
            yield pd.DataFrame(rows, columns=["title", "first", "middle", "last", "suffix", "nickname"])

    return parts(c)
