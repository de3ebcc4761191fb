"""Main text of web pages by differencing each page with its nearest by URL.

Pages of a host are put in the order of their URL paths; the nearest page is the neighbour that shares the longer prefix of the path. The text lines of
the two are aligned by a longest common subsequence, and the lines in it (navigation, headers, footers) are deleted.

Only URLs go through the per-host order, only hashes of lines through the pairing, and texts move once, to be cut; so a host of very many pages weighs little.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import NOT_SPACE, durable, hash_words, in_arrow, mix, q, row_key, split_words, text_chunks

# what a browser reads to the end tag, or to the end of the page, and never shows as text; <head> itself may go without tags, only its title has text
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK_TAG = re.compile(r"<(/?)(svg|noscript|template)\b[^>]*?(/?)>", re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|blockquote|pre|form|hr|dd|dt|dl|figure|figcaption|body|html|option|select|button)\b[^>]*|!doctype[^>]*)>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_BLANK = re.compile(r"\s+")
_URL = re.compile(r"^\s*(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?//([^/?#]*)([^?#]*)(\?[^#]*)?")


def _without_blocks(t: str) -> str:
    """Drawings, templates and what is for browsers without scripts go, from tag to end tag. One that is never closed, or closes itself, has no content."""
    tags = list(_BLOCK_TAG.finditer(t))
    last = {m[2].lower(): m.start() for m in tags if m[1]}
    parts, at, inside, begin = [], 0, None, 0
    for m in tags:
        name = m[2].lower()
        if inside is None and not m[1] and not m[3] and last.get(name, -1) > m.start():
            inside, begin = name, m.start()
        elif inside == name and m[1]:
            parts.append(t[at:begin])
            at, inside = m.end(), None
    return "".join([*parts, t[at:]])


def text_lines(page: str) -> list[str]:
    """The lines of text of a page: block tags break lines, other tags go, entities are decoded, blanks are single; empty lines are left out. A tag is what HTML takes for one: ``<`` and a letter, to the next ``>``."""
    t = _BREAK.sub("\n", _without_blocks(_DROP.sub("", page)))
    t = html.unescape(_TAG.sub("", t))
    return [x for x in (_BLANK.sub(" ", line).strip() for line in t.split("\n")) if x]


def locate(url: str | None) -> tuple[str | None, str]:
    """(host, path with query) of a URL; the host is None where there is none. Scheme, user, port, ``www.`` and fragment don't count."""
    m = _URL.match(url or "")
    if not m or not m[2]:
        return None, ""
    host = m[2].rpartition("@")[2].lower().partition(":")[0]
    host = host[4:] if host.startswith("www.") else host
    return host or None, (m[3] or "/") + (m[4] or "")


def common_lines(a: list, b: list) -> list[int]:
    """Indices in ``a`` of a longest common subsequence with ``b``; bit-parallel rows (Hyyro, 2004), so long pages do not cost a table of cells."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [], full
    for line in x:
        u = v & where.get(line, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    # a clear bit j of row i: one more common line than without line j; so it was won in the last row that cleared it
    mid: list[int] = []
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            mid.append(lo + i)
    return [*range(lo), *reversed(mid), *range(len(a) - hi, len(a))]


def line_hashes(lines: pa.Array) -> list[np.ndarray]:
    """A 64-bit hash of each line of each text, over its words and their places; lines hold single blanks only."""
    out: list[np.ndarray] = []
    for _, _, buf, offs in text_chunks(lines):
        cut = np.union1d(np.flatnonzero(buf == 10) + 1, offs[:-1])
        cut = cut[cut < len(buf)]
        st, en, first, m = split_words(buf, np.append(cut, len(buf)), NOT_SPACE)
        h = hash_words(buf, st, en, m)
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ mix(place.astype(np.uint64))), dtype=np.uint64)])
        line = mix(total[first[1:]] - total[first[:-1]]).view(np.int64)
        at = np.searchsorted(cut, offs)
        out += [line[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


_PAGES = "page_id long, key long, also long, host string, path string, hashes array<long>"


def _lines_of(b: pa.RecordBatch) -> pa.Array:
    return pa.array(["\n".join(text_lines(page)) for page in b.column("html").to_pylist()], pa.string())


def _parse(b: pa.RecordBatch) -> Iterator[dict]:
    where = [locate(url) for url in b.column("url").to_pylist()]
    yield {**{c: b.column(c) for c in ("page_id", "key", "also")}, "host": [h for h, _ in where], "path": [p for _, p in where], "hashes": [x.tolist() for x in line_hashes(_lines_of(b))]}


def _text(b: pa.RecordBatch) -> Iterator[dict]:
    yield {**{c: b.column(c) for c in ("page_id", "key", "also")}, "lines": _lines_of(b)}


def _shared_prefix(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _nearer(b: pa.RecordBatch) -> Iterator[dict]:
    """Of the paths before and after, the one that shares the longer prefix; the one before of two alike."""
    nodes, ids = [], []
    for path, before, after in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), b.column("after").to_pylist(), strict=True):
        x, y = _shared_prefix(path, before and before["path"]), _shared_prefix(path, after and after["path"])
        best = before if x >= y else after
        nodes.append(best and best["node"])
        ids.append(best and best["page_id"])
    yield {"host": b.column("host"), "path": b.column("path"), "pair": nodes, "pair_id": ids}


def _align(b: pa.RecordBatch) -> Iterator[dict]:
    gone = [common_lines(x, y) for x, y in zip(b.column("hashes").to_pylist(), b.column("pair_hashes").to_pylist(), strict=True)]
    yield {"key": b.column("key"), "also": b.column("also"), "pair_id": b.column("pair_id"), "gone": gone}


def _cut(b: pa.RecordBatch) -> Iterator[dict]:
    texts, sizes, counts = [], [], []
    for lines, gone in zip(b.column("lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
        own, drop = lines.split("\n") if lines else [], set(gone or [])
        texts.append("\n".join(x for i, x in enumerate(own) if i not in drop))
        sizes.append(len(own))
        counts.append(len(drop))
    yield {"page_id": b.column("page_id"), "pair_id": b.column("pair_id"), "text": texts, "n_lines": sizes, "n_deleted": counts}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, pair_id, text, n_lines, n_deleted): the lines of each page that are not aligned with the nearest page's.

    Nearest is, of the pages of the same host with another path, the one whose path shares the longest prefix; of two such the one that comes before in
    the order of paths; of several pages of that path the one of the least id (nulls last). A page of a host of its own, or of a URL that is null or has no host, has no
    pair and keeps all lines. Null html is an empty page, with an empty text. Rows alike in id, URL and html are one page; an
    id may have several pages. Pages are read whole, however long. An empty table gives an empty result; other columns are not read.
    """
    one = [q(id_col), q(url_col), q(html_col)]
    also = F.xxhash64(F.lit("also"), *one, *[c.isNull() for c in one])
    d = pages.select(q(id_col).cast("long").alias("page_id"), row_key(id_col, url_col, html_col).alias("key"), also.alias("also"), q(url_col).alias("url"), F.coalesce(q(html_col), F.lit("")).alias("html"))
    # hashes of lines are stored; pages are parsed once more for their text, which takes less than a table of all texts would
    parsed = durable(in_arrow(_parse, d, _PAGES).withColumn("node", F.monotonically_increasing_id()))
    # rows alike are one page: the first stands for all
    alike = parsed.groupBy("key", "also").agg(F.min("node").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = durable(parsed.select("key", "also", "node").join(alike, ["key", "also"]).where("node <> stays").select("node"))
    if not again.isEmpty():
        parsed = parsed.join(again, "node", "left_anti")
    placed = parsed.select("node", "key", "also", "page_id", "host", "path").where("host is not null")
    # one row a path, then its neighbours: URLs only
    first = F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "node"))
    paths = placed.groupBy("host", "path").agg(first.alias("r")).select("host", "path", F.struct("path", "r.node", "r.page_id").alias("r"))
    near = Window.partitionBy("host").orderBy("path")
    sides = paths.select("host", "path", F.lag("r").over(near).alias("before"), F.lead("r").over(near).alias("after")).where("before is not null or after is not null")
    chosen = in_arrow(_nearer, sides, "host string, path string, pair long, pair_id long")
    pairs = placed.join(chosen, ["host", "path"]).select("node", "key", "also", "pair", "pair_id")
    hashes = parsed.select("node", "hashes")
    both = pairs.join(hashes, "node").join(hashes.select(F.col("node").alias("pair"), F.col("hashes").alias("pair_hashes")), "pair")
    gone = in_arrow(_align, both.select("key", "also", "pair_id", "hashes", "pair_hashes"), "key long, also long, pair_id long, gone array<int>")
    lines = in_arrow(_text, d.select("page_id", "key", "also", "html"), "page_id long, key long, also long, lines string")
    whole = lines.join(gone.hint("merge"), ["key", "also"], "left").dropDuplicates(["key", "also"])
    return in_arrow(_cut, whole.select("page_id", "pair_id", "lines", "gone"), "page_id long, pair_id long, text string, n_lines int, n_deleted int")
