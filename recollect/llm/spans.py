"""What the scanners for personal data and secrets share: spans, their order and their text form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

#: kind, start, end (exclusive), in code points.
Span = tuple[str, int, int]


def in_order(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed, then end."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], place[s[0]], s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def best_set(spans: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Of spans (start, end, score, kind), the set without overlaps whose scores sum to the most."""
    from bisect import bisect_right

    spans = sorted(spans, key=lambda s: (s[1], s[0], s[3]))
    ends = [s[1] for s in spans]
    total, take = [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[0], 0, i)
        with_it = total[before] + s[2]
        take.append(before if with_it > total[i] else -1)
        total.append(max(total[i], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]
