"""MinHash signatures of word shingles, bands, and connected groups inside band buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from sparkloom.llm._common import grams, mix, row_of

_U32 = np.uint64(32)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the shingles of k words of each row; a row of fewer words has one shingle of all of them."""
    doc = row_of(first)
    g = grams(h, k)
    ok = doc[: len(g)] == doc[k - 1 :] if len(g) else np.empty(0, bool)
    hs, rows = [g[ok]], [doc[: len(g)][ok]]
    size = np.diff(first)
    for n in range(1, k):
        few = np.flatnonzero(size == n)
        if len(few):
            hs.append(grams(h, n)[first[:-1][few]])
            rows.append(few)
    hs, rows = np.concatenate(hs), np.concatenate(rows)
    if len(rows) and (np.diff(rows) < 0).any():
        o = np.argsort(rows, kind="stable")
        hs, rows = hs[o], rows[o]
    return hs, rows


class Hasher:
    """``k`` seeded 32-bit hash functions; the minimum of each over a row's shingles."""

    def __init__(self, k: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.k = k
        self.mul = r.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.xor = r.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)

    def minima(self, hs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have shingles, their minima: uint32 [rows, k])."""
        at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
        x = (hs >> _U32).astype(np.uint32)
        out = np.empty((len(at), self.k), np.uint32)
        tmp = np.empty_like(x)
        for i in range(self.k):
            np.bitwise_xor(x, self.xor[i], out=tmp)
            np.multiply(tmp, self.mul[i], out=tmp)
            out[:, i] = np.minimum.reduceat(tmp, at) if len(at) else 0
        return rows[at], out


def band_hashes(minima: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A 64-bit hash of each band of ``width`` minima: int64 [rows, bands]."""
    m = minima[:, : bands * width].reshape(len(minima), bands, width).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(minima), 1), np.uint64)
    for j in range(width):
        h = mix(h ^ (m[:, :, j] + np.uint64(0x632BE59BD9B4E019)))
    return h.view(np.int64)


def pack(minima: np.ndarray, bits: int) -> np.ndarray:
    """b-bit MinHash: the low bits of the mixed minima, packed: uint64 [rows, k * bits / 64]."""
    low = mix(minima.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    per = 64 // bits
    low = low.reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2)


def similarity(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Jaccard similarity from packed signatures (last axis), corrected for minima that collide in their low bits."""
    x = a ^ b
    y = x
    for i in range(1, bits):
        y = y | (x >> np.uint64(i))
    mask = np.uint64(sum(1 << (i * bits) for i in range(64 // bits)))
    k = a.shape[-1] * (64 // bits)
    same = 1 - np.bitwise_count(y & mask).sum(axis=-1) / k
    c = 2.0**-bits
    return (same - c) / (1 - c)


def bucket_edges(n_groups_start: np.ndarray, n: int, close: Callable[[int, np.ndarray], np.ndarray], first_close: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the connected groups in each bucket of rows.

    ``n_groups_start``: first row of each bucket; ``first_close``: whether a row is close to the first of its bucket. Buckets whose
    rows are all close to the first are done; in others the search goes on from each row reached, against the rows not yet reached, so
    every pair that could join two groups is compared.
    """
    ends = np.append(n_groups_start[1:], n)
    owner = np.repeat(n_groups_start, ends - n_groups_start)
    hit = first_close & (owner != np.arange(n))
    yield owner[hit], np.flatnonzero(hit)
    whole = np.logical_and.reduceat(first_close | (owner == np.arange(n)), n_groups_start) if n else np.empty(0, bool)
    for lo, hi in zip(n_groups_start[~whole].tolist(), ends[~whole].tolist(), strict=True):
        rest = np.arange(lo + 1, hi)
        near = first_close[lo + 1 : hi]
        queue, rest = list(rest[near]), rest[~near]
        while len(rest):
            at = queue.pop() if queue else None
            if at is None:
                at, rest = int(rest[0]), rest[1:]
                if not len(rest):
                    break
            near = close(at, rest)
            if near.any():
                yield np.full(int(near.sum()), at), rest[near]
                queue.extend(rest[near])
                rest = rest[~near]
