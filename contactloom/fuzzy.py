"""Similarity of two short strings without white space, 0 to 100."""

from __future__ import annotations


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one bit row."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len + len)."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of its length, cut short at both ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    windows = {long[max(0, k) : k + n] for k in range(1 - n, len(long))} if n else set()
    return max((ratio(short, w) for w in windows), default=0.0)


def similarity(a: str, b: str) -> float:
    """Whole-text ratio; beyond a length ratio of 1.5, or 0.9 of the partial ratio if larger."""
    whole = ratio(a, b)
    low, high = sorted((len(a), len(b)))
    return whole if not low or high / low < 1.5 else max(whole, 0.9 * partial_ratio(a, b))
