"""Similarity of texts from 0 to 100 by common subsequences (Indel similarity), in four forms."""

from __future__ import annotations

from functools import lru_cache


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one, windows at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    windows = {b[i : i + n] for i in range(len(b) - n + 1)} | {b[:i] for i in range(1, n)} | {b[len(b) - i :] for i in range(1, n)}
    for w in windows:
        best = max(best, ratio(a, w))
        if best == 100.0:
            break
    if len(a) == len(b) and best < 100.0:
        windows = {a[:i] for i in range(1, n)} | {a[n - i :] for i in range(1, n)}
        best = max(best, *(ratio(b, w) for w in windows)) if windows else best
    return best


@lru_cache(maxsize=100_000)
def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common words with and without what only one of the texts has."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    # differences are compared behind the common part
    first = f"{both} {only_x}".strip()
    second = f"{both} {only_y}".strip()
    best = ratio(first, second)
    if both:
        best = max(best, ratio(both, first), ratio(both, second))
    return best


METHODS = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}
