"""Benchmark decontamination by a generalised suffix automaton (Blumer et al., 1985) of the test items' words.

The automaton is built on the driver from the benchmark, flattened into sorted arrays and handed to the executors as a file that the workers of a machine map into
memory together. Training texts stream through it side by side: at each word it gives the longest passage ending there that occurs in some item, and
by its suffix links the longest such passage that exceeds a limit. A match that counts is made of runs of ``least`` words that occur in the benchmark, so only places where such runs
begin, by a sorted list of their hashes, are fed to it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from sparkloom.llm._common import WORD_BYTE, grams, hash_words, in_arrow, lean, pieces, q, row_of, split_words, text_chunks
from sparkloom.storage import new_path

#: A match of so many words is contamination, whatever share of an item it is.
MAX_WORDS = 13
#: A match that covers such a share of an item is contamination, if it has MIN_WORDS.
MAX_COVERAGE = 0.6
MIN_WORDS = 8
#: Words of one automaton; a larger benchmark has several, which texts go through one after another. Building one takes about 1 kB a word on the driver.
SHARD_WORDS = 1_000_000


class Automaton:
    """Generalised suffix automaton over words given as 64-bit hashes, as flat arrays.

    ``keys`` holds state * words + word of all transitions in order, ``to`` their states. Of a state: its suffix ``link``, the ``length`` of its longest passage, the
    ``size`` in words and the id of the shortest ``item`` that has its passages. ``grams`` are the hashes of all ``least`` words in a row.
    """

    ARRAYS = ("vocabulary", "grams", "keys", "to", "link", "length", "size", "item")

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int = MIN_WORDS):
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[grams(h, least) for _, h in items]]))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in items]]))
        wide = max(len(self.vocabulary), 1)
        nxt: dict[int, int] = {}
        out: list[list[int]] = [[]]  # the words that lead on from each state
        link, length, size, item = [-1], [0], [0], [-1]

        def new(n: int) -> int:
            out.append([])
            link.append(0)
            length.append(n)
            size.append(0)
            item.append(-1)
            return len(out) - 1

        def clone(p: int, to: int, c: int) -> int:
            copy = new(length[p] + 1)
            out[copy] = out[to][:]
            for w in out[to]:
                nxt[copy * wide + w] = nxt[to * wide + w]
            link[copy] = link[to]
            link[to] = copy
            while p >= 0 and nxt.get(p * wide + c) == to:
                nxt[p * wide + c] = copy
                p = link[p]
            return copy

        for ident, h in items:
            words = np.searchsorted(self.vocabulary, h).tolist()
            last = 0
            for c in words:
                to = nxt.get(last * wide + c)
                if to is not None:
                    last = to if length[to] == length[last] + 1 else clone(last, to, c)
                else:
                    cur = new(length[last] + 1)
                    p = last
                    while p >= 0 and p * wide + c not in nxt:
                        nxt[p * wide + c] = cur
                        out[p].append(c)
                        p = link[p]
                    if p >= 0:
                        to = nxt[p * wide + c]
                        link[cur] = to if length[to] == length[p] + 1 else clone(p, to, c)
                    last = cur
                if size[last] == 0 or (len(words), ident) < (size[last], item[last]):
                    size[last], item[last] = len(words), ident
        # an item that ends in a state holds the state's suffixes too
        for s in sorted(range(1, len(out)), key=length.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and size[s] and (size[up] == 0 or (size[s], item[s]) < (size[up], item[up])):
                size[up], item[up] = size[s], item[s]
        keys = np.fromiter(nxt.keys(), np.int64, len(nxt))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(nxt.values(), np.int32, len(nxt))[order]
        self.link, self.length, self.size = (np.array(x, np.int32) for x in (link, length, size))
        self.item = np.array(item, np.int64)

    def to_file(self, f) -> None:
        arrays = [getattr(self, n) for n in self.ARRAYS]
        f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def from_bytes(cls, raw: np.ndarray, at: int) -> tuple[Automaton, int]:
        """The automaton that begins at this byte, without copying, and where it ends."""
        auto = cls.__new__(cls)
        sizes = raw[at : at + 8 * len(cls.ARRAYS)].view(np.int64).tolist()
        at += 8 * len(cls.ARRAYS)
        for name, n, kind in zip(cls.ARRAYS, sizes, (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64), strict=True):
            width = np.dtype(kind).itemsize * n
            setattr(auto, name, raw[at : at + width].view(kind))
            at += width + -width % 8
        return auto, at

    def limits(self, max_words: int, max_coverage: float, min_words: int) -> np.ndarray:
        """For each state, itself or the next on its suffix links whose longest passage exceeds a limit; 0 if there is none."""
        ok = (self.length >= max_words) | ((self.length >= min_words) & (self.length >= max_coverage * self.size))
        best = np.where(ok, np.arange(len(ok)), np.where(self.link > 0, self.link, 0))
        while True:
            step = np.where(ok, best, best[best])
            if (step == best).all():
                return np.where(ok[best], best, 0)
            best = step

    def matches(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, max_words: int, max_coverage: float, min_words: int, best: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, item, its words) of the longest passage over a limit that ends at each place of the runs [lo, hi) of ``words``. All runs take a step together."""
        order = np.argsort(lo - hi, kind="stable")
        lo, size = lo[order], (hi - lo)[order]
        state, have = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        wide = max(len(self.vocabulary), 1)
        out: list[tuple[np.ndarray, ...]] = []
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            c = words[lo[:live] + t]
            s, n = state[:live], have[:live]
            todo = np.arange(live)
            while len(todo):
                key = s[todo] * wide + c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                s[todo[hit]] = self.to[at[hit]]
                n[todo[hit]] += 1
                todo = todo[~hit]
                n[todo[s[todo] == 0]] = 0
                todo = todo[s[todo] > 0]
                s[todo] = self.link[s[todo]]
                n[todo] = self.length[s[todo]]
            whole = (n >= max_words) | ((n >= min_words) & (n >= max_coverage * self.size[s]))
            up = best[np.maximum(self.link[s], 0)]
            got = np.flatnonzero(whole | (up > 0))
            if len(got):
                of = np.where(whole[got], s[got], up[got])
                long = np.where(whole[got], n[got], self.length[of])
                end = lo[got] + t + 1
                out.append((end - long, end, self.item[of], self.size[of].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def _outermost(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The spans that no other one contains, in order; of equal ones that of the shortest item, then the least id."""
    s, e, item, size = found
    o = np.lexsort((item, size, s, -e))
    s, e, item, size = s[o], e[o], item[o], size[o]
    # from the last end to the first: a span stays if it begins before all that end later or begin as early
    before = np.minimum.accumulate(np.append(np.int64(1) << 62, s))[:-1]
    keep = np.flatnonzero(s < before)[::-1]
    return s[keep], e[keep], item[keep], size[keep]


class Benchmark:
    """The automata of a benchmark, in a file that Spark sends to every machine."""

    def __init__(self, name: str):
        self.name = name
        self._automata: list[Automaton] | None = None
        self._best: dict[tuple, list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"name": self.name, "_automata": None, "_best": {}}

    @property
    def automata(self) -> list[Automaton]:
        if self._automata is None:
            path = SparkFiles.get(self.name)
            raw = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
            self._automata, at = [], 0
            while at < len(raw):
                one, at = Automaton.from_bytes(raw, at)
                self._automata.append(one)
        return self._automata

    def find(self, buf: np.ndarray, offs: np.ndarray, max_words: int, max_coverage: float, min_words: int) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray]:
        """(row, first word, end word, item, coverage) of contaminated spans, words counted over all rows; then the first word of each row."""
        st, en, first, m = split_words(buf, offs, WORD_BYTE)
        if not len(st) or not self.automata:
            return [], first
        h = hash_words(buf, st, en, m)
        doc = row_of(first)
        limits = (max_words, max_coverage, min_words)
        if limits not in self._best:
            self._best[limits] = [a.limits(*limits) for a in self.automata]
        found = []
        least = min(min_words, max_words)
        g = grams(h, least)
        one_row = doc[: len(g)] == doc[least - 1 :] if len(g) else np.empty(0, bool)
        for auto, best in zip(self.automata, self._best[limits], strict=True):
            if not len(auto.grams) or not len(g):
                continue
            hit = (auto.grams[np.minimum(np.searchsorted(auto.grams, g), len(auto.grams) - 1)] == g) & one_row
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            # places in a row are one run; runs of two rows never touch, as no run of words leaves its row
            cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
            lo, hi = at[cut], at[np.append(cut[1:], len(at)) - 1] + least
            size = hi - lo
            place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            word = np.minimum(np.searchsorted(auto.vocabulary, h[place]), len(auto.vocabulary) - 1)
            ends = np.cumsum(size)
            s, e, item, words = auto.matches(word, ends - size, ends, *limits, best)
            shift = (lo - (ends - size))[np.searchsorted(ends, s, "right")] if len(s) else s
            found.append((s + shift, e + shift, item, words))
        if not found:
            return [], first
        s, e, item, size = _outermost(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
        return list(zip(doc[s].tolist(), s.tolist(), e.tolist(), item.tolist(), ((e - s) / np.maximum(size, 1)).tolist(), strict=True)), first


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS, least: int = MIN_WORDS) -> Iterator[Automaton]:
    """Automata of all items, each of ``shard_words`` words or one longer item; items come to the driver one partition at a time. Items without words have no part in them."""
    t = benchmark.select(q(id_col).cast("long").alias("item"), q(text_col).alias("text")).where("text is not null").distinct()
    held: list[tuple[int, np.ndarray]] = []
    count = 0
    for r in t.toLocalIterator():
        for _, _, buf, offs in text_chunks(pa.array([r.text], pa.string()), lower=True):
            st, en, _, m = split_words(buf, offs, WORD_BYTE)
            if len(st):
                held.append((-1 if r.item is None else r.item, hash_words(buf, st, en, m)))
                count += len(st)
        if count >= shard_words:
            yield Automaton(held, least)
            held, count = [], 0
    if held:
        yield Automaton(held, least)


def build(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS, least: int = MIN_WORDS) -> Benchmark:
    """The benchmark's automata as a file of Spark's, some 90 bytes a word of the benchmark; for matches of ``least`` words and more."""
    spark = benchmark.sparkSession
    shared = new_path(spark, "automaton")
    with tempfile.TemporaryDirectory() as folder:  # on the driver, until the file lies in the shared folder
        local = os.path.join(folder, "automaton")
        with open(local, "wb") as f:
            for one in automata(benchmark, id_col, text_col, shard_words, least):
                one.to_file(f)
        jvm = spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(shared)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{local}"), to)
    spark.sparkContext.addFile(shared)
    return Benchmark(shared.rsplit("/", 1)[-1])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, item_id, coverage) of each match that exceeds a limit.

    A match is a run of words that occurs in an item. It exceeds a limit if it has ``max_words`` words, or ``min_words`` words and the share ``max_coverage`` of the shortest item
    that holds it (ties: the least item_id), which is the one named; of matches that do, those are given that no other one contains. Words are runs of
    letters, digits and underscores without regard to case, counted from 0. So an item of fewer than ``min_words`` words is never found. Null and empty texts have no matches; each
    row is searched on its own and whole, however long; repeated rows give repeated results. An empty table or benchmark gives an empty result; an item of null id is named -1.
    """
    bench = build(benchmark, shard_words=shard_words, least=min(min_words, max_words))

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        doc_id = b.column("doc_id")
        for lo, _, buf, offs in text_chunks(b.column("text"), lower=True):
            hits, first = bench.find(buf, offs, max_words, max_coverage, min_words)
            if hits:
                row = np.array([x[0] for x in hits])
                base = first[row]
                s, e = np.array([x[1] for x in hits]) - base, np.array([x[2] for x in hits]) - base
                yield {"doc_id": doc_id.take(pa.array(lo + row)), "start_word": s.astype(np.int32), "end_word": e.astype(np.int32), "n_words": (e - s).astype(np.int32), "item_id": [x[3] for x in hits], "coverage": [x[4] for x in hits]}

    d = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text")).where("text is not null")
    return in_arrow(run, d, "doc_id long, start_word int, end_word int, n_words int, item_id long, coverage double")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, max_coverage: float = MAX_COVERAGE, min_words: int = MIN_WORDS, text_col: str = "text", size_col: str = "n_chars", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents without their contaminated spans, with all columns; ``size_col``, where there is one, is set anew for texts that change.

    A span goes from its first word's first to its last word's last character; what stood around it is joined by one blank.
    A document of which nothing but white space is left goes; all others stay, those of null or empty text unchanged. Texts are searched whole, however long;
    repeated rows are cut alike. An empty benchmark leaves all as it is, an empty table stays empty.
    """
    bench = build(benchmark, shard_words=shard_words, least=min(min_words, max_words))
    names = docs.columns
    text_at = [c.lower() for c in names].index(text_col.lower())
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_at):
            col = b.column(text_at)
            change: dict[int, str] = {}
            for lo, hi, buf, offs in text_chunks(col):
                # lower case can change the number of bytes; then the row is cut in its lower-cased words' order
                for lo2, hi2, low, offs2 in text_chunks(col.slice(lo, hi - lo), lower=True):
                    hits, _ = bench.find(low, offs2, max_words, max_coverage, min_words)
                    if not hits:
                        continue
                    st, en, first, _ = split_words(buf, offs, WORD_BYTE)
                    _, _, first_low, _ = split_words(low, offs2, WORD_BYTE)
                    cuts: dict[int, list[tuple[int, int]]] = {}
                    for row, s, e, _, _ in hits:
                        shift = first[lo2 + row] - first_low[row]
                        cuts.setdefault(lo2 + row, []).append((int(st[s + shift]), int(en[e - 1 + shift])))
                    raw = buf.tobytes()
                    for row, spans in cuts.items():
                        parts, at = [], int(offs[row])
                        for s, e in sorted(spans):
                            if s > at:
                                parts.append(raw[at:s])
                            at = max(at, e)
                        parts.append(raw[at : int(offs[row + 1])])
                        change[lo + row] = b" ".join(p.strip(b" ") for p in parts).strip().decode()
            if change:
                keep = np.ones(b.num_rows, bool)
                texts = col.to_pylist()
                for i, t in change.items():
                    texts[i] = t
                    keep[i] = bool(t)
                cols = list(b.columns)
                cols[text_at] = pa.array(texts, col.type)
                for j, c in enumerate(names):
                    if c.lower() == size_col.lower() and pa.types.is_integer(cols[j].type):
                        sizes = cols[j].to_pylist()
                        for i, t in change.items():
                            sizes[i] = len(t)
                        cols[j] = pa.array(sizes, cols[j].type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))
            yield b

    return docs.mapInArrow(lean(clean), schema)
