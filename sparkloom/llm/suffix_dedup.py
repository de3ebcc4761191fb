"""Repeated passages by suffix sorting: a shallow multikey quicksort, then blind tries (Manzini and Ferragina, 2004).

A window of ``length`` words that occurs at two places makes all its words *repeated*; the result is the maximal runs of
repeated words. The corpus is never sorted as one string. Winnowing (Schleimer et al., 2003) picks anchors so that equal
windows hold an anchor at the same place; only anchors whose words occur elsewhere keep their surroundings, which
are brought together by anchor, and there the text after the anchors and the reversed text before them are suffix-sorted. The
neighbours' common prefixes tell exactly which windows are equal: comparison is by words, the anchor hash only sends
them to the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import NOT_SPACE, cut_words, grams, grouped, hash_words, in_arrow, q, row_key, row_of, split_words, text_chunks, window_extreme

#: Words that a passage must have.
LENGTH = 50
#: Symbols that the multikey quicksort looks at before the blind tries take over.
SHALLOW = 4


def shallow_sort(s: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows of ``s`` by their first ``depth`` symbols, and the runs of rows that agree in all of them.

    Multikey quicksort (Bentley and Sedgewick, 1997): each segment is split into less, equal and greater by one symbol
    around a median of three, and the equal part goes on to the next symbol. All segments are split in one vectorised pass.
    """
    n = len(s)
    order = np.arange(n)
    lo, hi, d = np.array([0]), np.array([n]), np.array([0])
    deep: list[tuple[int, int]] = []
    while True:
        done = (d == depth) & (hi - lo > 1)
        deep.extend(zip(lo[done].tolist(), hi[done].tolist(), strict=True))
        go = (d < depth) & (hi - lo > 1)
        lo, hi, d = lo[go], hi[go], d[go]
        if not len(lo):
            return order, sorted(deep)
        size = hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        idx = np.arange(len(seg)) + np.repeat(lo - (np.cumsum(size) - size), size)
        cur = order[idx]
        key = s[cur, d[seg]]
        at = np.cumsum(size) - size
        three = np.sort(np.stack([key[at], key[at + size // 2], key[at + size - 1]]), axis=0)[1]
        side = seg * 3 + (key > three[seg]) + (key >= three[seg])
        order[idx] = cur[np.argsort(side, kind="stable")]
        count = np.bincount(side, minlength=3 * len(lo))
        ends = np.cumsum(count) + np.repeat(lo - at, 3)
        deeper = np.repeat(d, 3)
        deeper[1::3] += 1
        lo, hi, d = ends - count, ends, deeper


def blind_trie(rows: list[bytes], width: int = 8) -> tuple[list[int], list[int]]:
    """Order of equally long strings of ``width``-byte symbols, and the symbols that each shares with the one before it.

    The trie keeps only branching positions and symbols. A string goes down blindly to some leaf, is compared with that leaf
    once, and is inserted where they part.
    """
    full = len(rows[0]) // width
    root: list = [rows[0], 0]  # leaf: [string, indices...]; inner node: (depth, {symbol: child})
    for i in range(1, len(rows)):
        s = rows[i]
        node = root
        while type(node) is tuple:
            d = node[0] * width
            kids = node[1]
            node = kids.get(s[d : d + width]) or next(iter(kids.values()))
        leaf = node[0]
        if leaf == s:
            node.append(i)
            continue
        a, b = 0, full  # symbols shared: the largest common prefix, by bisection
        while b - a > 1:
            mid = (a + b) // 2
            if s[: mid * width] == leaf[: mid * width]:
                a = mid
            else:
                b = mid
        parent, node = None, root
        while type(node) is tuple and node[0] < a:
            parent = node
            node = node[1][s[node[0] * width : node[0] * width + width]]
        mine = s[a * width : a * width + width]
        if type(node) is tuple and node[0] == a:
            node[1][mine] = [s, i]
            continue
        inner = (a, {leaf[a * width : a * width + width]: node, mine: [s, i]})
        if parent is None:
            root = inner
        else:
            parent[1][s[parent[0] * width : parent[0] * width + width]] = inner
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            kids = sorted(node[1].items(), reverse=True)
            stack.extend((kid, node[0]) for _, kid in kids[:-1])
            stack.append((kids[-1][1], shared))
        else:
            order.extend(node[1:])
            lcp.extend([shared] + [full] * (len(node) - 2))
    return order, lcp


def suffix_sort(s: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of ``s`` (symbols after each start) and the longest common prefix with the row before."""
    order, deep = shallow_sort(s, min(shallow, s.shape[1]))
    lcp = np.zeros(len(s), np.int64)
    head = s[:, : min(shallow, s.shape[1])]
    if len(s) > 1:
        lcp[1:] = np.cumprod(head[order[1:]] == head[order[:-1]], axis=1).sum(axis=1)
    big = np.ascontiguousarray(s.astype(">u8"))
    width = s.shape[1] * 8
    for lo, hi in deep:
        at = order[lo:hi]
        raw = big[at].tobytes()
        sub, shared = blind_trie([raw[i * width : (i + 1) * width] for i in range(hi - lo)])
        order[lo:hi] = at[sub]
        lcp[lo + 1 : hi] = shared[1:]
    return order, lcp


def equal_windows(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each context in reading order, the fewest and most words before the anchor at which a window repeats, then the same for windows of which there is an earlier copy; the fewest is ``length`` where there is none."""
    n = len(right)
    ro, rl = suffix_sort(right)
    lo_, ll = suffix_sort(left) if left.shape[1] else (np.arange(n), np.zeros(n, np.int64))
    out = [np.full(n, length), np.full(n, -1), np.full(n, length), np.full(n, -1)]
    g, h = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(left.shape[1] + 1):
        g[ro] = np.cumsum(rl < length - back)
        h[lo_] = np.cumsum(ll < back) if back else 0
        ok = np.flatnonzero((n_left >= back) & (n_right >= length - back))
        if not len(ok):
            continue
        _, first, inv = np.unique(g[ok] * (n + 1) + h[ok], return_index=True, return_inverse=True)
        many = np.bincount(inv, weights=copies[ok])[inv] > 1
        later = first[inv] < np.arange(len(ok))
        for k, hit in ((0, many), (2, later)):
            x = ok[hit]
            out[k][x] = np.minimum(out[k][x], back)
            out[k + 1][x] = back
    return tuple(out)


def _winnow(buf: np.ndarray, offs: np.ndarray, length: int):
    """Words (starts, ends, first of each row, row of each), hash of the k words at each word, and the least hash of each window of ``length`` words; 0 for windows that leave their row."""
    k = length // 2 + 1
    st, en, first, m = split_words(buf, offs, NOT_SPACE)
    doc = row_of(first)
    if len(st) < length:
        return st, en, first, doc, np.empty(0, np.uint64), np.empty(0, np.uint64)
    g = np.maximum(grams(hash_words(buf, st, en, m), k), np.uint64(1))
    least = window_extreme(g, length - k + 1, np.minimum)
    least[doc[: len(least)] != doc[length - 1 :]] = 0
    return st, en, first, doc, g, least


def _anchors(length: int):
    w = length - length // 2

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        key, doc_id = b.column("key").to_numpy(), b.column("doc_id")
        for lo, _, buf, offs in text_chunks(b.column("text")):
            _, _, first, doc, g, least = _winnow(buf, offs, length)
            if not len(least):
                continue
            edge = np.zeros(w - 1, np.uint64)
            pick = np.flatnonzero(window_extreme(np.concatenate([edge, least, edge]), w, np.maximum) == g)
            if len(pick):
                yield {"h": g[pick].view(np.int64), "key": key[lo + doc[pick]], "doc_id": doc_id.take(pa.array(lo + doc[pick])), "pos": (pick - first[doc[pick]]).astype(np.int32)}

    return run


def _contexts(length: int):
    w = length - length // 2

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        key, doc_id = b.column("key").to_numpy(), b.column("doc_id")
        hits = b.column("hits")
        flat = hits.flatten()
        pos, h = flat.field("pos").to_numpy(), flat.field("h").to_numpy()
        at = np.concatenate([[0], np.cumsum(np.diff(hits.offsets.to_numpy()))])
        for lo, hi, buf, offs in text_chunks(b.column("text")):
            st, en, first, _, g, least = _winnow(buf, offs, length)
            part = slice(at[lo], at[hi])
            doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
            p = pos[part]
            pick = first[doc] + p
            # of the windows that hold an anchor, only those go with it of which it is the least: they begin from ``most`` to ``fewest`` words before it
            fewest, most = np.full(len(pick), w), np.full(len(pick), -1)
            for back in range(w):
                own = (pick >= back) & (pick - back < len(least))
                own[own] = least[pick[own] - back] == g[pick[own]]
                fewest[own & (most < 0)] = back
                most[own] = back
            raw = buf.tobytes()
            f, t = st[pick - most], en[pick + length - fewest - 1]
            yield {"h": h[part], "key": key[lo + doc], "doc_id": doc_id.take(pa.array(lo + doc)), "pos": p, "left": most.astype(np.int32), "context": [raw[x:y] for x, y in zip(f.tolist(), t.tolist(), strict=True)]}

    return run


def _passages(length: int):
    reach = length - (length // 2 + 1)

    def spans(t: pa.Table) -> dict:
        n = t.num_rows
        context, left = t.column("context").combine_chunks(), t.column("left").to_numpy()
        h, pos = t.column("h").to_numpy(), t.column("pos").to_numpy()
        # rows come in the order of anchor, context, document and place: of equal contexts the first stands for all
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = (h[1:] == h[:-1]) & (left[1:] == left[:-1]) & np.asarray(pc.equal(context.slice(1), context.slice(0, n - 1)))
        rep = np.flatnonzero(~same)
        copies = np.diff(np.append(rep, n))
        # the text is distinct contexts; symbols are words
        words, first = [], [np.zeros(1, np.int64)]
        for _, _, buf, offs in text_chunks(context.take(pa.array(rep)).cast(pa.string())):
            st, en, fst, m = split_words(buf, offs, NOT_SPACE)
            words.append(hash_words(buf, st, en, m))
            first.append(fst[1:] + first[-1][-1])
        words, first = np.concatenate(words), np.concatenate(first)
        a = first[:-1] + left[rep]
        n_right = first[1:] - a
        padded = np.concatenate([words, np.zeros(length, np.uint64)])
        step = np.arange(length)
        right = np.where(step < n_right[:, None], padded[a[:, None] + step], np.uint64(0))
        back = np.arange(1, reach + 1)
        before = np.where(back <= left[rep][:, None], words[np.maximum(a[:, None] - back, 0)], np.uint64(0))
        # reading order decides which copy is the first
        doc_id = t.column("doc_id").combine_chunks().take(pa.array(rep))
        known = np.asarray(doc_id.is_valid())
        order = np.lexsort((pos[rep], t.column("key").to_numpy()[rep], np.asarray(doc_id.fill_null(0)), ~known))
        got = equal_windows(right[order], before[order], n_right[order], left[rep][order], copies[order], length)
        least, most, least2, most2 = (np.empty_like(x) for x in got)
        for x, y in zip((least, most, least2, most2), got, strict=True):
            x[order] = y
        # a later copy of a context repeats whatever its windows are
        owner = np.cumsum(~same) - 1
        all_least, all_most = length - n_right, left[rep]
        lo2 = np.where(same, all_least[owner], least2[owner])
        hi2 = np.where(same, all_most[owner], most2[owner])
        key, ids = t.column("key"), t.column("doc_id").combine_chunks()
        out = []
        for role, x, y in (("repeated", least[owner], most[owner]), ("remove", lo2, hi2)):
            ok = np.flatnonzero((y >= 0) & (x <= y))
            out.append((role, ok, pos[ok] - y[ok], pos[ok] + length - x[ok]))
        ok = np.concatenate([o[1] for o in out])
        return {
            "key": key.take(pa.array(ok)).combine_chunks(), "doc_id": ids.take(pa.array(ok)), "role": pa.array([o[0] for o in out for _ in range(len(o[1]))], pa.string()),
            "s": pa.array(np.concatenate([o[2] for o in out]).astype(np.int32)), "e": pa.array(np.concatenate([o[3] for o in out]).astype(np.int32)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "h", 1 << 15):
            out = spans(t)
            yield pa.RecordBatch.from_pydict({c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for c, v in out.items()})

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of words that lie in windows of ``length`` words occurring at two places or more.

    Columns: doc_id, role, start_word, end_word (exclusive), n_words. Words are what white space parts, counted from 0. A row of role
    ``repeated`` is a run of words that occur elsewhere too; of role ``remove``, the part of which an earlier copy exists, earlier by doc_id
    (nulls last), then by place: removing those keeps one copy of everything.

    Null and empty texts and texts of fewer than ``length`` words give no rows. Rows alike in doc_id and text are one document.
    Passages that repeat within one document count. Texts are read whole, however long. Other columns are not read. An empty table gives an empty result.
    """
    merged = _runs(docs, length, id_col, text_col)
    return merged.select("doc_id", "role", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents without the passages of which an earlier copy exists (the role ``remove``), with all columns; ``size_col``, where there is one, is set anew for texts that change.

    Of what repeats, the first copy stays, by doc_id (nulls last) and place. A document of which nothing but white space is left goes; null and empty texts stay; rows alike are cut alike;
    texts are read whole, however long. An empty table stays empty.
    """
    spans = _runs(docs, length, id_col, text_col).where("role = 'remove'").select("key", "doc_id", F.col("start_word").alias("s"), F.col("end_word").alias("e"))
    return cut_words(docs, spans, NOT_SPACE, id_col, text_col, size_col)


def _runs(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, role, run, start_word, end_word)."""
    if length < 4:
        raise ValueError("length must be at least 4 words")
    d = docs.select(row_key(id_col, text_col).alias("key"), q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"))
    d = d.where("text is not null")
    # a document is its id and the hash of id and text together: the hash alone would confuse some of a very large corpus
    found = in_arrow(_anchors(length), d, "h long, key long, doc_id long, pos int")
    # places, not rows: repeated rows are one document
    both = Window.partitionBy("h")
    shared = found.withColumn("a", F.min(F.struct("key", "pos")).over(both)).withColumn("b", F.max(F.struct("key", "pos")).over(both)).where("a <> b")
    # one struct as the key of the groups, the join and the duplicates, in which nulls are equal: all three share one partitioning, so texts move once
    doc = F.struct("key", "doc_id")
    hits = shared.groupBy(doc.alias("doc")).agg(F.collect_set(F.struct("pos", "h")).alias("hits"))
    with_hits = d.withColumn("own", doc).join(hits.hint("merge"), F.col("own") == F.col("doc")).dropDuplicates(["doc"]).drop("own", "doc")
    wide = in_arrow(_contexts(length), with_hits, "h long, key long, doc_id long, pos int, left int, context binary")
    near = wide.repartition("h").sortWithinPartitions("h", "left", "context", F.col("doc_id").asc_nulls_last(), "key", "pos")
    spans = near.mapInArrow(_passages(length), "key long, doc_id long, role string, s int, e int")
    by = Window.partitionBy("key", "doc_id", "role").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    return runs.groupBy("key", "doc_id", "role", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
