"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed, one after another, into the bits of multiword Shift-And masks (Baeza-Yates and Gonnet, 1992; Navarro and Raffinot, 2002). A step over
one byte moves every rule at once: state = ((state << 1) & mask[byte]) | (state & loop). The URLs of a batch go through it side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm._common import in_arrow, q, text_chunks

#: (rule, glob over the canonical URL, action). ``*`` is any run of bytes, ``?`` any one byte; the whole URL must match. Later rules win.
RULES: list[tuple[str, str, str]] = [
    ("spam_host", "*spam*.example.*/*", "deny"),
    ("pills_host", "*pills*.example.*/*", "deny"),
    ("casino_host", "*casino*.example.*/*", "deny"),
    ("login_page", "*/login*", "deny"),
    ("cart_page", "*/cart*", "deny"),
    ("session_query", "*[?]*sessionid=*", "deny"),
    ("binary_file", "*.zip", "deny"),
    ("image_file", "*.jp?g", "deny"),
    ("short_numbers", "blog.*.example.net/en/?", "deny"),
    ("allowed_blog", "blog.*.example.org/*", "allow"),
]
#: Query fields that only track.
TRACKING = ("utm_", "gclid", "fbclid", "ref")
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*)://")


def canonical(url: str) -> bytes | None:
    """host[:port]/path[?query]: no scheme, user, fragment, leading ``www.``, default port, trailing slash or tracking fields; host in lower case, escapes of plain characters undone, dot segments resolved, query fields sorted. None for what has no host."""
    u = url.strip()
    scheme = "http"
    # only what stands at the beginning is a scheme: a URL in the query is none of it
    if m := _SCHEME.match(u):
        scheme, u = m[1].lower(), u[m.end() :]
    elif u.startswith("//"):
        u = u[2:]
    u = u.partition("#")[0]
    rest, mark, query = u.partition("?")
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].lower().rstrip(".")
    if host.startswith("www."):
        host = host[4:]
    name, colon, port = host.rpartition(":")
    if colon and (port == "" or port == {"http": "80", "https": "443"}.get(scheme)):
        host = name
    if not host:
        return None
    parts: list[bytes] = []
    for x in path.split("/"):
        p = _plain(x)
        if p == b"..":
            parts = parts[:-1]
        elif p not in (b"", b"."):
            parts.append(p)
    fields = sorted(_plain(f) for f in query.split("&") if f and not f.lower().startswith(TRACKING[0]) and f.lower().partition("=")[0] not in TRACKING[1:])
    out = host.encode() + b"/" + b"/".join(parts)
    return out + (b"?" + b"&".join(fields) if mark and fields else b"")


def _plain(s: str) -> bytes:
    raw = s.encode()
    if b"%" not in raw:
        return raw
    out, i = bytearray(), 0
    while i < len(raw):
        one = raw[i : i + 3]
        if one[:1] == b"%" and len(one) == 3:
            c = unquote_to_bytes(one)
            if len(c) == 1:
                out += c if (c.isalnum() or c in b"-._~") else one.upper()
                i += 3
                continue
        out += raw[i : i + 1]
        i += 1
    return bytes(out)


class Globs:
    """Glob rules as Shift-And masks of 64-bit words. ``[...]`` lists bytes, ``[!...]`` all but those; ``\\\\`` quotes the next character."""

    def __init__(self, globs: list[str]):
        self.n = len(globs)
        bits: list[np.ndarray] = []  # bytes that each bit lets in
        loops: list[bool] = []
        first, final = [], []
        for g in globs:
            # one bit before the rule's first character holds its start, so leading stars can loop there
            first.append(len(bits))
            bits.append(np.zeros(256, bool))
            loops.append(False)
            i, raw = 0, g.encode()
            while i < len(raw):
                c = raw[i]
                ok = np.zeros(256, bool)
                if c == 42:
                    loops[-1] = True
                    i += 1
                    continue
                if c == 63:
                    ok[:] = True
                elif c == 92 and i + 1 < len(raw):
                    i += 1
                    ok[raw[i]] = True
                elif c == 91 and raw.find(b"]", i + 2) > 0:
                    end = raw.find(b"]", i + 2)
                    inside = raw[i + 1 : end]
                    ok[list(inside.lstrip(b"!") if inside[:1] == b"!" else inside)] = True
                    if inside[:1] == b"!":
                        ok = ~ok
                    i = end
                else:
                    ok[c] = True
                bits.append(ok)
                loops.append(False)
                i += 1
            final.append(len(bits) - 1)
        words = -(-max(len(bits), 1) // 64)
        self.mask = np.zeros((256, words), np.uint64)
        self.loop, self.begin = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for b, (ok, again) in enumerate(zip(bits, loops, strict=True)):
            one = np.uint64(1) << np.uint64(b % 64)
            self.mask[ok, b // 64] |= one
            if again:
                self.loop[b // 64] |= one
        for b in first:
            self.begin[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        self.final = [(b // 64, np.uint64(b % 64)) for b in final]

    def match(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Whether each string matches each rule: bool [strings, rules]."""
        n = len(offs) - 1
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        start, size = offs[:-1][order], size[order]
        state = np.broadcast_to(self.begin, (n, len(self.begin))).copy()
        one = np.uint64(1)
        for i in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size, -i, "left"))
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.mask[buf[start[:live] + i]]) | (s & self.loop)
        out = np.empty((n, self.n), bool)
        for r, (w, b) in enumerate(self.final):
            out[order, r] = (state[:, w] >> b & one).astype(bool)
        return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, canonical_url, rules, rule, kept) for every row: all rules that match, in their order; the last of them, which decides; whether the page stays.

    A page that no rule matches stays. A null, empty or hostless URL has a null canonical URL, matches nothing and does not stay. Repeated rows give
    repeated results; URLs are read whole, however long; other columns are not read. An empty list of rules keeps every page that has a host; an empty table gives an empty result.
    """
    globs = Globs([g for _, g, _ in rules])

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        urls = [canonical(u) if u else None for u in b.column("url").to_pylist()]
        col = pa.array([None if u is None else u.decode() for u in urls], pa.string())
        for lo, hi, buf, offs in text_chunks(col):
            hit = globs.match(buf, offs)
            names, last, kept = [], [], []
            for u, row in zip(urls[lo:hi], hit, strict=True):
                found = np.flatnonzero(row).tolist() if u is not None else []
                names.append([rules[r][0] for r in found])
                last.append(rules[found[-1]][0] if found else None)
                kept.append(u is not None and (not found or rules[found[-1]][2] == "allow"))
            yield {"page_id": b.column("page_id").slice(lo, hi - lo), "canonical_url": col.slice(lo, hi - lo), "rules": names, "rule": last, "kept": kept}

    d = pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).alias("url"))
    return in_arrow(run, d, "page_id long, canonical_url string, rules array<string>, rule string, kept boolean")


def keep_allowed(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """The pages whose URL stays, with all columns as they are.

    Null, empty and hostless URLs go. Repeated rows are treated alike; an empty table stays empty, an empty list of rules keeps every page that has a host. URLs are read whole, however long.
    """
    globs = Globs([g for _, g, _ in rules])
    at = [c.lower() for c in pages.columns].index(url_col.lower())
    allow = np.array([a == "allow" for _, _, a in rules], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [canonical(u) if u else None for u in b.column(at).to_pylist()]
            keep = np.array([u is not None for u in urls], bool)
            for lo, hi, buf, offs in text_chunks(pa.array([b"" if u is None else u for u in urls], pa.binary()).cast(pa.string())):
                hit = globs.match(buf, offs)
                if len(allow):
                    last = len(allow) - 1 - hit[:, ::-1].argmax(axis=1)
                    keep[lo:hi] &= ~hit.any(axis=1) | allow[last]
            yield b.filter(pa.array(keep))

    return pages.mapInArrow(run, pages.schema)
