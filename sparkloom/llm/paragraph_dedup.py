"""Duplicate paragraphs by MinHash banding, exact verification and connected components.

Paragraphs are of two kinds. A *line* has near copies: bands are tuned for recall (8 bands of 3 minima meet a pair of Jaccard 0.8 with probability 0.997), and rows that
share a band are verified by the exact Jaccard similarity of their shingle sets, so chance collisions do no harm. A set so small that one more
shingle is too much is near its equals only; its one band is the whole set. A *piece* is what a passage inside a long line, or one across many short lines, is found by:
the words of a whole text are cut, without regard to lines, before each word whose two-word hash is the least of ``REACH`` words on both sides, so
equal passages are cut alike wherever they stand. Pieces have some 11 words; at that size one changed word is too much, so a piece's copies are equal in all words.

A short line or a single piece that has a copy is no repeated passage yet: the larger the corpus, the more phrases of some words any two texts have in common, until every clean
text holds some. So what is reported are paragraphs with copies that follow each other without a gap and have ``PASSAGE_WORDS`` words together, be it one line or ten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._buckets import BLOCK, links
from sparkloom.llm._common import WORD_BYTE, cut_words, durable, grams, hash_words, in_arrow, mix, q, row_key, row_of, sifted, split_words, text_chunks, window_extreme
from sparkloom.llm._graph import components
from sparkloom.llm._minhash import Hasher, band_hashes, shingles
from sparkloom.storage import forget

#: Lines of fewer words have one shingle at most; their words take part in pieces.
MIN_WORDS = 3
#: Least exact Jaccard similarity of two lines' shingle sets.
THRESHOLD = 0.8
SHINGLE = 2
BANDS, WIDTH = 8, 3
#: A piece begins at the least hash of so many words before and after.
REACH = 5
#: Two cuts lie more than REACH words apart; only the first and the last piece of a text can be shorter.
PIECE_WORDS = REACH + 1
#: Least words of paragraphs with copies in a row; more than one piece mostly has.
PASSAGE_WORDS = 16


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows (one more at the end), the row of each, its index in the row. The line break is the line's last byte."""
    cut = np.flatnonzero(buf == 10) + 1
    starts = np.union1d(cut, offs[:-1])
    starts = starts[starts < len(buf)]
    row = np.searchsorted(offs, starts, "right") - 1
    return np.append(starts, len(buf)), row, np.arange(len(starts)) - np.searchsorted(starts, offs[row])


def cuts(h: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """First words of the pieces of all rows, from the words' hashes and the first word of each row (one more at the end)."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64)
    row = row_of(first)
    high = np.uint64(0xFFFFFFFFFFFFFFFF)
    g = np.full(n, high)
    two = grams(h, 2)
    inside = row[1:] == row[:-1]
    g[:-1][inside] = two[inside] >> np.uint64(1)
    # rows lie apart by ``reach`` words, so that none sees its neighbour's
    at = np.arange(n) + reach * (row + 1)
    wide = np.full(at[-1] + 1 + reach, high)
    wide[at] = g
    before = window_extreme(wide, reach, np.minimum)[at - reach]
    after = window_extreme(np.append(wide, np.full(1, high)), reach, np.minimum)[at + 1]
    least = (g < before) & (g <= after) & (g < high)
    least[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(least)


def _whole_sets(hs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct shingles of each row that has some, and a hash of all of them."""
    hs, of = _sets(hs, of)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return np.diff(np.append(at, len(of))), mix(np.add.reduceat(mix(hs), at)).view(np.int64)


def _sets(hs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((hs, of))
    hs, of = hs[o], of[o]
    once = np.append(True, (hs[1:] != hs[:-1]) | (of[1:] != of[:-1])) if len(hs) else np.empty(0, bool)
    return hs[once], of[once]


def _names(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each span, in their order, as two numbers."""
    size = hi - lo
    pos = (np.arange(len(h)) - np.repeat(lo, size)).astype(np.uint64) if size.sum() == len(h) else None
    if pos is None:
        raise ValueError("spans must cover all words")
    out = []
    for salt in (0x1B873593, 0x2545F4914F6CDD1D):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((h + np.uint64(salt)) ^ mix(pos + np.uint64(salt))), dtype=np.uint64)])
        out.append(mix(total[hi] - total[lo]).view(np.int64))
    return out[0], out[1]


#: One row a paragraph; ``bands`` of lines only.
_UNITS = "line boolean, s1 long, s2 long, key long, doc_id long, paragraph int, start_word int, n_words int, bands array<long>"


def _units(min_words: int, threshold: float, shingle: int, bands: int, width: int, reach: int, piece_words: int):
    hasher = Hasher(bands * width, seed=11)

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        key, doc_id = b.column("key").to_numpy(), b.column("doc_id")
        for lo, _, buf, offs in text_chunks(b.column("text"), lower=True):
            line, row, idx = _lines(buf, offs)
            st, en, first, m = split_words(buf, line, WORD_BYTE)
            h = hash_words(buf, st, en, m)
            if not len(h):
                continue
            size = np.diff(first)
            s1, s2 = _names(h, first[:-1], first[1:])
            base = first[np.searchsorted(row, np.arange(len(offs)))]  # the first word of each row
            rows = np.flatnonzero(size >= max(1, min_words))
            hs, of = shingles(h, first, shingle)
            pick = np.zeros(len(size), bool)
            pick[rows] = True
            hs, of = hs[pick[of]], of[pick[of]]
            ends, band = np.zeros(1, np.int32), np.empty(0, np.int64)
            if len(rows):
                n, whole = _whole_sets(hs, of)
                of, minima = hasher.minima(hs, of)
                band = band_hashes(minima, bands, width)
                few = n < threshold * (n + 1)
                band[few, 0] = whole[few]
                keep = (~few)[:, None] | (np.arange(bands) == 0)
                ends = np.append(0, np.cumsum(keep.sum(axis=1))).astype(np.int32)
                band = band[keep]
                yield {
                    "line": np.ones(len(rows), bool), "s1": s1[rows], "s2": s2[rows], "key": key[lo + row[rows]], "doc_id": doc_id.take(pa.array(lo + row[rows])), "paragraph": idx[rows].astype(np.int32),
                    "start_word": (first[:-1][rows] - base[row[rows]]).astype(np.int32), "n_words": size[rows].astype(np.int32), "bands": pa.ListArray.from_arrays(ends, pa.array(band)),
                }
            begin = cuts(h, base, reach)
            end = np.append(begin[1:], len(h))
            s1, s2 = _names(h, begin, end)
            row = row_of(base)[begin]
            nth = np.arange(len(begin)) - np.searchsorted(begin, base[row])
            p = np.flatnonzero(end - begin >= piece_words)
            yield {
                "line": np.zeros(len(p), bool), "s1": s1[p], "s2": s2[p], "key": key[lo + row[p]], "doc_id": doc_id.take(pa.array(lo + row[p])), "paragraph": nth[p].astype(np.int32),
                "start_word": (begin - base[row])[p].astype(np.int32), "n_words": (end - begin)[p].astype(np.int32), "bands": pa.nulls(len(p), pa.list_(pa.int64())),
            }

    return run


def _shingle_sets(min_words: int, shingle: int):
    """The shingle set of each line whose words are wanted, as sorted hashes."""

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        want = b.column("want")
        flat = want.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(np.diff(want.offsets.to_numpy()))])
        for lo, hi, buf, offs in text_chunks(b.column("text"), lower=True):
            line, row, _ = _lines(buf, offs)
            st, en, first, m = split_words(buf, line, WORD_BYTE)
            h = hash_words(buf, st, en, m)
            if not len(h):
                continue
            start = np.searchsorted(row, np.arange(hi - lo))
            pick = start[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))] + flat[at[lo] : at[hi]]
            chosen = np.zeros(len(line) - 1, bool)
            chosen[pick] = True
            s1, s2 = _names(h, first[:-1], first[1:])
            hs, of = shingles(h, first, shingle)
            hs, of = _sets(hs[chosen[of]], of[chosen[of]])
            edge = np.searchsorted(of, np.append(np.flatnonzero(chosen), len(chosen)))
            raw = hs.tobytes()
            yield {"s1": s1[chosen], "s2": s2[chosen], "payload": [raw[8 * x : 8 * y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]}

    return run


def _close(threshold: float):
    def of(payloads: list[bytes]):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets])

        def close(i: int, rows: np.ndarray) -> np.ndarray:
            a, n = sets[i], sizes[i]
            out = np.zeros(len(rows), bool)
            can = np.flatnonzero(np.minimum(sizes[rows], n) >= threshold * np.maximum(sizes[rows], n))
            if not len(can):
                return out
            many = sizes[rows[can]]
            both = np.concatenate([sets[j] for j in rows[can].tolist()])
            at = np.minimum(np.searchsorted(a, both), max(n - 1, 0))
            hit = np.add.reduceat((a[at] == both).astype(np.int64), np.cumsum(many) - many)
            out[can] = hit >= threshold * (n + many - hit) - 1e-9
            return out

        return close

    return of


def duplicate_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, reach: int = REACH, piece_words: int = PIECE_WORDS, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, kind, paragraph, start_word, n_words, cluster_doc, cluster_paragraph, removed) for each paragraph of a repeated passage.

    ``kind`` is ``line`` or ``piece``; ``paragraph`` counts the lines, or the pieces, of the text from 0, and ``start_word`` its words. A cluster is a connected component of
    pairs of lines of at least ``threshold``, or all equal pieces; its first paragraph, by doc_id (nulls last) and place, names it and stays, the others are ``removed``. Words are
    runs of letters, digits and underscores without regard to case.

    Of the paragraphs of a kind that have copies, those that follow each other in a text without a word between are a passage; a passage of fewer than ``passage_words`` words is left
    alone, so the first of a cluster, which names it, may itself be in no row.

    Lines of fewer than ``min_words`` words are left alone as lines, but their words are part of pieces like all others. Pieces of fewer than ``piece_words`` words are left alone.

    Null and empty texts have no paragraphs. Copies within one document count. Rows alike in doc_id and text are one document. Texts are read whole, however long.
    An empty table gives an empty result; other columns are not read.
    """
    found = _copies(docs, min_words, threshold, shingle, bands, width, reach, piece_words, passage_words, id_col, text_col, block)
    return found.drop("key")


def drop_duplicate_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, reach: int = REACH, piece_words: int = PIECE_WORDS, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """The documents without the paragraphs that are ``removed``, with all columns; ``size_col``, where there is one, is set anew for texts that change.

    A document of which nothing but white space is left goes; null and empty texts stay; rows alike are cut alike; texts are read whole, however long. An empty table stays empty.
    """
    found = _copies(docs, min_words, threshold, shingle, bands, width, reach, piece_words, passage_words, id_col, text_col, block).where("removed")
    spans = found.select("key", "doc_id", F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e"))
    return cut_words(docs, spans, WORD_BYTE, id_col, text_col, size_col)


def _copies(docs: DataFrame, min_words: int, threshold: float, shingle: int, bands: int, width: int, reach: int, piece_words: int, passage_words: int, id_col: str, text_col: str, block: int) -> DataFrame:
    d = docs.select(row_key(id_col, text_col).alias("key"), q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text")).where("text is not null")
    # one pass over the texts; all that follows reads this table, which has no texts
    units = durable(in_arrow(_units(min_words, threshold, shingle, bands, width, reach, piece_words), d, _UNITS))
    lines = units.where("line")
    band = lines.select(F.explode("bands").alias("band"), "s1", "s2")
    # the halves of a name serve to see whether a bucket has two different lines, and which texts to read
    shared = band.groupBy("band").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("band")
    # few bands are shared: they are stored in few files, and of all bands only those that may be among them move a second time
    shared = durable(shared.hint("rebalance", "band"))
    met = durable(sifted(band, F.col("band"), shared)[1].join(shared, "band").select("band", F.struct("s1", "s2").alias("node")).distinct())
    wanted = lines.join(met.select("node.s1", "node.s2").distinct(), ["s1", "s2"], "left_semi")
    # of equal lines one is read
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "paragraph")
    chosen = wanted.groupBy("s1", "s2").agg(F.min(place).alias("p")).groupBy("p.key", "p.doc_id").agg(F.collect_list("p.paragraph").alias("want"))
    chosen = chosen.select(F.col("key").alias("k"), F.col("doc_id").alias("i"), "want")
    texts = d.join(chosen.hint("merge"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("text", "want")
    payloads = in_arrow(_shingle_sets(min_words, shingle), texts, "s1 long, s2 long, payload binary")
    payloads = durable(payloads.select(F.struct("s1", "s2").alias("node"), "payload").dropDuplicates(["node"]))
    roots = durable(components(links(met, payloads, _close(threshold), "struct<s1:bigint,s2:bigint>", block)))
    for done in (shared, met, payloads):
        forget(done)
    # what may have a copy: names seen at two places, and lines that are near another
    twice = units.groupBy("line", "s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line", "s1")
    twice = durable(twice.unionByName(roots.select(F.lit(True).alias("line"), F.col("node.s1").alias("s1"))).distinct())
    # an inner join, as ``twice`` has each name once: a semi join would be moved ahead of the sieve
    places = durable(sifted(units.drop("bands"), F.col("s1"), twice.select("s1"))[1].join(twice, ["line", "s1"]).distinct())
    for done in (units, twice):
        forget(done)
    named = places.withColumn("node", F.struct("s1", "s2")).join(roots.withColumn("line", F.lit(True)), ["line", "node"], "left").withColumn("cluster", F.coalesce("root", "node"))
    best = named.groupBy("line", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("best")).where("n > 1").drop("n")
    removed = ~((F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("paragraph") == F.col("best.paragraph")))
    kind = F.when(F.col("line"), "line").otherwise("piece")
    found = named.join(best, ["line", "cluster"]).select("key", "doc_id", kind.alias("kind"), "paragraph", "start_word", "n_words", F.col("best.doc_id").alias("cluster_doc"), F.col("best.paragraph").alias("cluster_paragraph"), removed.alias("removed"))
    # a window a text: its paragraphs with copies, in order
    text = Window.partitionBy("key", "doc_id", "kind")
    inside = text.orderBy("start_word")
    apart = F.coalesce(F.col("start_word") > F.lag(F.col("start_word") + F.col("n_words")).over(inside), F.lit(True))
    found = found.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    long = F.sum("n_words").over(Window.partitionBy("key", "doc_id", "kind", "passage"))
    return found.withColumn("long", long).where(F.col("long") >= passage_words).drop("apart", "passage", "long")
