"""Shared kernels: vectorised tokenising and hashing over Arrow string buffers, durable lineage cuts, safe column names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import stored

#: Bytes of text worked on at a time; a longer single text is worked on whole.
CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_pow = np.ones(1, np.uint64)

#: Bits of a sieve a key, of its blocks (one row each), and of all blocks at most.
SIEVE_BITS, BLOCK_BITS, SIEVE_MOST = 16, 1 << 15, 1 << 28

#: Any run of bytes that are not ASCII white space is a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, underscore, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def q(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*cols: str) -> Column:
    """A 64-bit hash of a row; a null differs from an empty text. Rows alike in ``cols`` count as one document.

    By itself it can't tell apart the documents of a very large corpus (among 3e10 some two dozen pairs collide), so it goes with the id wherever documents are matched or dropped.
    """
    return F.xxhash64(*[q(c) for c in cols], *[q(c).isNull() for c in cols])


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a table in the folder that all executors share (spark.checkpoint.dir), removed at the end of the process."""
    return stored(df)


def sifted(df: DataFrame, key: Column, keys: DataFrame, most: int = SIEVE_MOST) -> tuple[DataFrame, DataFrame]:
    """(rest, maybe): the rows of ``df`` whose ``key``, a long, is not in ``keys``, and those whose key may be. ``keys`` has one column and is read from a table.

    For a join of a table of texts with some of its rows: only ``maybe`` need move, whatever the size of ``keys``. A Bloom filter of blocks goes to the tasks, ``SIEVE_BITS`` bits a key, with which
    one row in 200 is in ``maybe`` by chance. Of more than ``most`` bits none is made; beyond that more rows are in ``maybe``, but none that it must have is missing. A null key is like any other.
    """
    blocks = min(keys.count() * SIEVE_BITS, most) // BLOCK_BITS + 1
    words = BLOCK_BITS // 64

    def places(h: Column) -> list[Column]:
        return [F.shiftright(F.xxhash64(h), 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(3)]

    block_of = lambda h: F.coalesce(F.pmod(h, F.lit(blocks)), F.lit(0)).cast("long")
    word_of = lambda p: F.shiftright(p, 6)
    bit_of = lambda p: p.bitwiseAND(63).cast("int")
    h = q(keys.columns[0])
    ones = keys.select(block_of(h).alias("b"), F.explode(F.array(*places(h))).alias("p"))
    ones = ones.select((F.col("b") * words + word_of(F.col("p"))).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(F.col("p"))).alias("bits"))
    every = keys.sparkSession.range(blocks * words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    full = ones.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    block, bits = fresh(df, "loom_block"), fresh(df, "loom_bits")
    rows = full.groupBy(F.shiftright("w", words.bit_length() - 1).alias(block)).agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("x"))
    sieve = F.broadcast(durable(rows.select(block, F.col("x.bits").alias(bits))))

    both = df.join(sieve, block_of(key) == F.col(block))
    hit = F.lit(1).cast("long")
    for p in places(key):
        hit = hit.bitwiseAND(F.call_function("shiftright", F.col(bits)[word_of(p).cast("int")], bit_of(p)))
    cut = lambda x: both.where(hit == x).select(*[q(c) for c in df.columns])
    return cut(0), cut(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        p = np.full(max(n, 2 * len(_pow), 64), _P, np.uint64)
        p[0] = 1
        _pow = np.cumprod(p, dtype=np.uint64)
    return _pow


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array, without copying the bytes."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(col: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes; a null reads as an empty text. With ``lower``, each chunk is put into lower case when its turn comes."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return
    raw, offs = _bytes_of(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        if lower:
            yield lo, hi, *_bytes_of(pc.utf8_lower(col.slice(lo, hi - lo)))
        else:
            yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK_BYTES of text, so that what is rewritten never stands beside a whole batch."""
    for b in batches:
        for lo, hi, _, _ in text_chunks(b.column(text_at)):
            yield b.slice(lo, hi - lo)


def give_back() -> None:
    """Free memory that Arrow and the C library hold on to goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow that gives memory back after its last batch: Spark's workers live on between tasks, and what they hold counts as their executor's."""

    def then_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then_back


def split_words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, the first word of each row (one more entry at the end), the mask of word bytes."""
    m = kind[buf]
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64), m
    cut = offs[:-1][(offs[:-1] < len(buf)) & (offs[:-1] > 0)]
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    start[cut] = m[cut]
    end[:-1] &= ~m[1:]
    end[cut - 1] = m[cut - 1]
    st, en = np.flatnonzero(start), np.flatnonzero(end) + 1
    return st, en, np.searchsorted(st, offs), m


def hash_words(buf: np.ndarray, st: np.ndarray, en: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; never 0."""
    if not len(st):
        return np.empty(0, np.uint64)
    ln = en - st
    first = np.cumsum(ln) - ln
    pos = np.arange(first[-1] + ln[-1]) - np.repeat(first, ln)
    h = np.add.reduceat(_BYTE[buf[m]] * powers(int(ln.max()))[pos], first)
    h = mix(h + ln.astype(np.uint64))
    h[h == 0] = 1
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by doubling; rows must be told apart by the caller."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, step, shift, size = np.zeros(n, np.uint64), 0, h, int(_Q), 1, 1
    while True:
        if k & size:
            out += np.uint64(shift) * power[have : have + n]
            have += size
            shift = shift * step % 2**64
        if have == k:
            return mix(out)
        power = power[: len(power) - size] + np.uint64(step) * power[size:]
        step = step * step % 2**64
        size *= 2


def window_extreme(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        a = op(a[: len(a) - size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def in_arrow(fn, df: DataFrame, schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch that gives a dict of columns, or None for no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in fn(b):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(lean(run), schema)


def grouped(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows, from batches in the order of ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        other = np.flatnonzero(k != k[-1])
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield t.slice(0, at)
        held = t.slice(at).to_batches()
        count = t.num_rows - at
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def cut_words(docs: DataFrame, spans: DataFrame, mask: np.ndarray, id_col: str, text_col: str, size_col: str) -> DataFrame:
    """The documents without the words of ``spans`` (key, doc_id, s, e: words that ``mask`` makes), what stands around a span joined by one blank; ``size_col`` is set anew.

    A document of which nothing but white space is left goes, all others stay with all columns; rows alike are cut alike.
    """
    k, found = fresh(docs, "loom_key"), fresh(docs, "loom_spans")
    names = list(docs.columns)
    at = [c.lower() for c in names].index(text_col.lower())
    grouped_ = stored(spans.groupBy("key", "doc_id").agg(F.collect_list(F.struct("s", "e")).alias(found)).withColumnsRenamed({"key": "loom__k", "doc_id": "loom__i"}))
    same = (q(k) == F.col("loom__k")) & q(id_col).cast("long").eqNullSafe(F.col("loom__i"))
    marked = docs.withColumn(k, row_key(id_col, text_col)).join(grouped_, same, "left").select(*[q(c) for c in names], q(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)[: len(names)]
            hit = b.column(len(names))
            keep = np.ones(b.num_rows, bool)
            change: dict[int, str] = {}
            for i in np.flatnonzero(np.asarray(hit.is_valid())).tolist():
                raw = cols[at][i].as_py().encode()
                st, en, _, _ = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), mask)
                parts, here = [], 0
                for x in sorted(hit[i].as_py(), key=lambda x: (x["s"], x["e"])):
                    s, e = int(st[x["s"]]), int(en[x["e"] - 1])
                    if s > here:
                        parts.append(raw[here:s])
                    here = max(here, e)
                text = b" ".join(x for p in [*parts, raw[here:]] if (x := p.strip(b" "))).strip().decode()
                change[i], keep[i] = text, bool(text)
            if change:
                texts = cols[at].to_pylist()
                for i, t in change.items():
                    texts[i] = t
                cols[at] = pa.array(texts, cols[at].type)
                for j, c in enumerate(names):
                    if c.lower() == size_col.lower() and pa.types.is_integer(cols[j].type):
                        sizes = cols[j].to_pylist()
                        for i, t in change.items():
                            sizes[i] = len(t)
                        cols[j] = pa.array(sizes, cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([b.schema.field(j) for j in range(len(names))])).filter(pa.array(keep))

    return marked.mapInArrow(run, docs.schema)
