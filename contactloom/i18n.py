"""Language packs: aliases of the vocabulary in other languages, cached as JSON files.

A pack is generated by any ``translate(phrases, code) -> phrases`` callable; none is built in.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import tempfile
import time
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from .aliases import builtin_vocabulary
from .fields import ContactError

Translate = Callable[[list[str], str], list[str]]
_LOG = logging.getLogger(__name__)

# Language codes and names; a translator may use another code for some.
LANGUAGES = {
    "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "it": "Italian", "nl": "Dutch", "pl": "Polish", "ro": "Romanian", "tr": "Turkish", "ru": "Russian",
    "ja": "Japanese", "zh": "Chinese (Simplified)", "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "sv": "Swedish", "da": "Danish", "nb": "Norwegian", "fi": "Finnish", "cs": "Czech",
    "uk": "Ukrainian", "el": "Greek", "hu": "Hungarian", "th": "Thai", "vi": "Vietnamese", "id": "Indonesian", "ms": "Malay", "he": "Hebrew", "bg": "Bulgarian", "hr": "Croatian",
    "sk": "Slovak", "sl": "Slovenian", "sr": "Serbian", "lt": "Lithuanian", "lv": "Latvian", "et": "Estonian", "ca": "Catalan", "tl": "Filipino", "sw": "Swahili", "af": "Afrikaans",
}
TRANSLATOR_CODES = {"zh": "zh-CN", "nb": "no", "he": "iw"}
#: Fields whose names are not translated: machine stamps, CRM internals, platforms known by one name.
# Fields that packs leave out.
SKIPPED = frozenset("created_at updated_at last_contacted utm_parameters metadata source_id source_service lead_status lifecycle_stage score owner email_opt_out subscribed verified referrer_url discord telegram".split())


def cache_dirs() -> list[Path]:
    """Where packs are looked for: the environment's folder, then the user's.  Never created here."""
    own = os.environ.get("CONTACTLOOM_LANGUAGES")
    return [*([Path(own)] if own else []), Path.home() / ".cache" / "contactloom" / "languages"]


def language_code(code: object) -> str | None:
    """A supported code in lower case, or None; anything else never becomes a file name."""
    found = code.strip().lower() if isinstance(code, str) else ""
    return found if found in LANGUAGES else None


def checked_pack(data: Any, path: Path) -> dict[str, Any] | None:
    """``data`` where it is a language pack; a warning and None where it is not."""
    fields = data.get("fields") if isinstance(data, dict) else None
    good = isinstance(fields, dict) and {"language_code", "language_name"} <= set(data)
    good = good and all(isinstance(f, str) and f.strip() and isinstance(a, list) and all(isinstance(x, str) and x.strip() for x in a) for f, a in fields.items())
    if not good:
        _LOG.warning("ignoring the language pack %s: not of the expected shape", path)
    return data if good else None


def load_pack(code: str, dirs: Iterable[str | Path] | None = None) -> dict[str, Any] | None:
    """The first usable pack of a language; unknown codes and missing packs are logged, not fatal."""
    known = language_code(code)
    if known is None:
        _LOG.warning("unknown language %r", code)
        return None
    for folder in cache_dirs() if dirs is None else dirs:
        path = Path(folder) / f"{known}.json"
        if path.is_file():
            try:
                pack = checked_pack(json.loads(path.read_text(encoding="utf-8")), path)
            except (OSError, ValueError) as error:
                _LOG.warning("ignoring the language pack %s: %s", path, error)
                continue
            if pack is not None:
                return pack
    _LOG.warning("no language pack for %r", known)
    return None


def discover(dirs: Iterable[str | Path] | None = None) -> list[str]:
    """Codes of all packs in the folders."""
    found = {p.stem for d in (cache_dirs() if dirs is None else dirs) if Path(d).is_dir() for p in Path(d).glob("*.json")}
    return [c for c in LANGUAGES if c in found]


def variants(phrase: str) -> set[str]:
    """Spellings of a translated phrase: as it is, underscored, joined, hyphenated, without accents."""
    low = phrase.lower().strip()
    if len(low) < 2:
        return set()
    plain = unicodedata.normalize("NFKD", low).encode("ascii", "ignore").decode().strip()
    out = set()
    for text in (low, plain):
        out |= {text, re.sub(r"\s+", "_", text), re.sub(r"[\s_\-]+", "", text)}
    out.add(re.sub(r"\s+", "-", low))
    return {v for v in out if len(v) > 1}


def _translated(phrases: list[str], code: str, translate: Translate, retries: int, backoff: float) -> dict[str, str]:
    """All phrases at once, with retries; where that fails, one by one, leaving out what fails."""

    def attempt(some: list[str]) -> list[str] | None:
        for n in range(retries + 1):
            try:
                got = translate(some, TRANSLATOR_CODES.get(code, code))
                return got if len(got) == len(some) else None
            except Exception as error:  # a translator may fail in any way
                _LOG.info("translation to %s failed: %s", code, error)
                if n < retries:
                    time.sleep(backoff * 2**n)
        return None

    every = attempt(phrases)
    pairs = zip(phrases, every, strict=True) if every is not None else ((p, got[0]) for p in phrases if (got := attempt([p])))
    return {p: t for p, t in pairs if isinstance(t, str) and t.strip()}


def generate_language(code: str, translate: Translate, folder: str | Path, *, force: bool = False, retranslate: Sequence[str] = (), retries: int = 1, backoff: float = 0.5) -> dict[str, Any]:
    """Make or complete the pack of a language in ``folder``.

    Fields that a pack already has are kept unless forced or named in ``retranslate``; fields that
    left the vocabulary go; English aliases are not repeated.  Nothing is written when no phrase
    could be translated.
    """
    known = language_code(code)
    if known is None:
        raise ContactError(f"unsupported language {code!r}")
    vocabulary = builtin_vocabulary()["fields"]
    phrases = {f: f.replace("_", " ") for f in vocabulary if f not in SKIPPED}
    old = load_pack(known, [folder]) if (Path(folder) / f"{known}.json").is_file() else None
    kept = {} if force or old is None else {f: a for f, a in old["fields"].items() if f in phrases and f not in retranslate}
    wanted = [f for f in phrases if f not in kept]
    if not wanted and old is not None:
        return old
    english = {a.lower().strip() for names in vocabulary.values() for a in names}
    done = _translated([phrases[f] for f in wanted], known, translate, retries, backoff)
    fields = dict(kept)
    for f in wanted:
        if (text := done.get(phrases[f])) and (new := sorted(variants(text) - english)):
            fields[f] = new
        elif old is not None and f in old["fields"]:
            fields[f] = old["fields"][f]
    if not fields:
        raise ContactError(f"nothing could be translated to {known}; no pack was written")
    pack = {"language_code": known, "language_name": LANGUAGES[known], "generated_at": datetime.now(timezone.utc).isoformat(), "source_version": builtin_vocabulary()["version"], "fields": {f: fields[f] for f in phrases if f in fields}}
    Path(folder).mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(pack, f, indent=2, ensure_ascii=False)
        os.replace(temporary, Path(folder) / f"{known}.json")
    finally:
        Path(temporary).unlink(missing_ok=True)
    return pack


def main(argv: list[str] | None = None, translate: Translate | None = None) -> int:
    """Generator command.  Without a translator only ``--list`` and ``--dry-run`` work."""
    parser = argparse.ArgumentParser(prog="contactloom-languages")
    parser.add_argument("--languages", nargs="*")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--retranslate-fields", nargs="*", default=[])
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--workers", type=int, default=6)
    parser.add_argument("--timeout", type=float, default=10.0)
    parser.add_argument("--retries", type=int, default=1)
    parser.add_argument("--retry-backoff", type=float, default=0.5)
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    if args.list:
        print("\n".join(f"{c}  {name}" for c, name in LANGUAGES.items()))
        return 0
    wanted = [language_code(c) or parser.error(f"unknown language {c!r}") for c in args.languages or LANGUAGES]
    if args.dry_run:
        print("\n".join(wanted))
        return 0
    if translate is None:
        parser.error("no translator is configured; call main(argv, translate)")
    folder = cache_dirs()[0]
    failed = 0
    with ThreadPoolExecutor(max(1, min(8, args.workers))) as pool:
        jobs = {c: pool.submit(generate_language, c, translate, folder, force=args.force, retranslate=args.retranslate_fields, retries=args.retries, backoff=args.retry_backoff) for c in wanted}
        for c, job in jobs.items():
            try:
                print(f"{c}: {len(job.result()['fields'])} fields")
            except ContactError as error:
                failed += 1
                print(f"{c}: {error}")
    return 1 if failed else 0
