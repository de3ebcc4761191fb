"""Language identification of code-switched text by a linear-chain conditional random field (Lafferty et al., 2001).

Each word's label is a language. Emissions come from affix, byte-trigram and lexicon features, transitions are learned, and forward-backward gives the
posterior of each label at each word of the whole document. Training is on a bounded sample of labelled rows (SAMPLE documents a language, SAMPLE_WORDS
words of each); documents made of lines of several languages are mixed in, so that switches are learned too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import WORD_BYTE, hash_words, in_arrow, lean, mix, q, row_key, split_words, text_chunks

#: Labelled documents of each language, and words of each, that the model is trained on.
SAMPLE, SAMPLE_WORDS = 100, 2000
#: Expected share of words that a document's language must have.
MIN_SHARE = 0.5
#: Share of words that the lexicon must hold, in documents of MIN_WORDS words or more: text in none of the labels' languages, or in none at all, has next to none,
#: however many labels there are. Documents of the labels' languages have a quarter and more.
MIN_KNOWN, MIN_WORDS = 0.1, 10
#: Bytes of text judged at a time; the posteriors of its words take many times as much.
PIECE_BYTES = 1 << 19
#: Steps of the optimiser and its ridge penalty.
STEPS, RIDGE = 40, 1e-5
#: Hashed features; lexicon entries follow them.
_HASHED = 1 << 17
_BLOCK = 256
_LETTER = WORD_BYTE.copy()
_LETTER[[*range(48, 58), 95]] = False


def _features(buf: np.ndarray, st: np.ndarray, en: np.ndarray, lexicon: np.ndarray, h: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """[(words, feature)] of affixes and lexicon, then the trigrams' features and words."""
    ln = en - st
    one: list[tuple[np.ndarray, np.ndarray]] = []
    b = buf.astype(np.uint64)
    for n in (1, 2, 3, 4):
        w = np.flatnonzero(ln >= n)
        for side, at in ((0, st[w]), (1, en[w] - n)):
            v = np.zeros(len(w), np.uint64)
            for j in range(n):
                v = v << np.uint64(8) | b[at + j]
            one.append((w, (mix(v + np.uint64((2 * n + side) << 40)) % np.uint64(_HASHED)).astype(np.int32)))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        w = np.flatnonzero(lexicon[at] == h)
        one.append((w, (_HASHED + at[w]).astype(np.int32)))
    many = np.maximum(ln - 2, 0)
    word = np.repeat(np.arange(len(ln)), many)
    p = np.arange(len(word)) + np.repeat(st - (np.cumsum(many) - many), many)
    v = b[p] << np.uint64(16) | b[p + 1] << np.uint64(8) | b[p + 2] if len(p) else np.empty(0, np.uint64)
    return one, (mix(v + np.uint64(1 << 50)) % np.uint64(_HASHED)).astype(np.int32), word


def _emissions(weights: np.ndarray, one: list, tri: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    s = np.zeros((n, weights.shape[1]), np.float32)
    for w, f in one:
        s[w] += weights[f]
    if len(tri):
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        s[word[at]] += np.add.reduceat(weights[tri], at, axis=0)
    return s


def forward_backward(score: np.ndarray, begins: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior of each label at each word of the sequences that begin where ``begins`` is true; with ``pairs`` also the expected transitions.

    Exact for chains of any length: products of the words' transfer matrices are formed in blocks, all blocks at once, then messages pass
    from block to block, then within all blocks at once.
    """
    n, k = score.shape
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    t, s = np.exp(trans - trans.max()).astype(np.float64), np.exp(start - start.max()).astype(np.float64)
    # positions in blocks first, so that a step over all blocks reads consecutive memory; sums are scaled every few steps, long before they underflow
    blocks = -(-n // _BLOCK)
    pad = blocks * _BLOCK - n
    e = np.ascontiguousarray(np.concatenate([e, np.ones((pad, k))]).reshape(blocks, _BLOCK, k).transpose(1, 0, 2))
    b = np.concatenate([begins, np.ones(pad, bool)]).reshape(blocks, _BLOCK).T
    fresh = [np.flatnonzero(x) for x in b]
    m = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(_BLOCK):
        step = (m.reshape(-1, k) @ t).reshape(m.shape)
        if len(fresh[i]):
            step[fresh[i]] = m[fresh[i]].sum(axis=2, keepdims=True) * s
        m = step * e[i][:, None, :]
        if i % 8 == 7:
            m /= m.sum(axis=(1, 2), keepdims=True)
    into, back = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.ones(k) / k
    for i in range(blocks):
        into[i] = a
        a = a @ m[i]
        a /= a.sum()
    a = np.ones(k) / k
    for i in range(blocks - 1, -1, -1):
        back[i] = a
        a = m[i] @ a
        a /= a.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = into
    for i in range(_BLOCK):
        step = a @ t
        if len(fresh[i]):
            step[fresh[i]] = a[fresh[i]].sum(axis=1, keepdims=True) * s
        a = step * e[i]
        if i % 8 == 7:
            a /= a.sum(axis=1, keepdims=True)
        alpha[i] = a
    a, turned = back, np.ascontiguousarray(t.T)
    for i in range(_BLOCK - 1, -1, -1):
        beta[i] = a
        a = (e[i] * a) @ turned
        if len(fresh[i]):
            a[fresh[i]] = 1.0
        if i % 8 == 0:
            a /= a.sum(axis=1, keepdims=True)
    alpha, beta, e = (x.transpose(1, 0, 2) for x in (alpha, beta, e))
    post = (alpha * beta).reshape(-1, k)[:n]
    post /= post.sum(axis=1, keepdims=True)
    if not pairs:
        return post, None
    f, g = alpha.reshape(-1, k)[: n - 1], (e * beta).reshape(-1, k)[1:n]
    on = ~begins[1:]
    z = np.einsum("ni,ij,nj->n", f[on], t, g[on])
    return post, np.einsum("ni,nj->ij", f[on] / z[:, None], g[on]) * t


class Model:
    """Weights of a trained field: ``labels``, ``lexicon`` (hashes), ``weights`` [features, labels], ``start``, ``trans``."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((_HASHED + len(lexicon), k), np.float32)
        self.start, self.trans = np.zeros(k), np.zeros((k, k))

    def posteriors(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word that has a letter, its posteriors [words, labels], whether the lexicon has it)."""
        st, en, first, m = split_words(buf, offs, WORD_BYTE)
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        ok = letters[en] > letters[st]
        h = hash_words(buf, st, en, m)[ok]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[ok]
        st, en = st[ok], en[ok]
        if not len(st):
            return row, np.empty((0, len(self.labels))), np.empty(0, bool)
        # each distinct word of the chunk is scored once
        _, once, word = np.unique(h, return_index=True, return_inverse=True)
        score = _emissions(self.weights, *_features(buf, st[once], en[once], self.lexicon, h[once]), len(once))[word]
        at = np.minimum(np.searchsorted(self.lexicon, h[once]), max(len(self.lexicon) - 1, 0))
        known = (self.lexicon[at] == h[once])[word] if len(self.lexicon) else np.zeros(len(h), bool)
        return row, forward_backward(score, np.append(True, row[1:] != row[:-1]), self.start, self.trans)[0], known


def train(rows: list[tuple[str, str]], steps: int = STEPS, ridge: float = RIDGE, seed: int = 3) -> Model | None:
    """A field trained on (text, language) rows; None if no row has words. The likelihood is maximised by Adam on full batches."""
    rows = sorted((t, lang) for t, lang in rows if t and lang)
    r = np.random.default_rng(seed)
    lines = [(x, lang) for t, lang in rows for x in t.split("\n") if x.strip()]
    docs: list[list[tuple[str, str]]] = [[(t, lang)] for t, lang in rows]
    order = r.permutation(len(lines)).tolist()
    for i in range(0, len(order), 8):
        docs.append([lines[j] for j in order[i : i + 8]])
    labels = sorted({lang for _, lang in rows})
    parts = [(x, labels.index(lang), i) for i, d in enumerate(docs) for x, lang in d]
    if not parts:
        return None
    col = pa.array([x for x, _, _ in parts], pa.large_string())
    _, _, buf, offs = next(text_chunks(col, lower=True, limit=1 << 62))
    st, en, first, m = split_words(buf, offs, WORD_BYTE)
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    ok = letters[en] > letters[st]
    h = hash_words(buf, st, en, m)[ok]
    part = np.repeat(np.arange(len(parts)), np.diff(first))[ok]
    st, en = st[ok], en[ok]
    if not len(st):
        return None
    y = np.array([p[1] for p in parts])[part]
    doc = np.array([p[2] for p in parts])[part]
    seen, at, kind, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    model = Model(labels, seen[times >= 4])
    k, n = len(labels), len(st)
    one, tri, word = _features(buf, st[at], en[at], model.lexicon, seen)
    begins = np.append(True, doc[1:] != doc[:-1])
    gold = np.zeros((n, k))
    gold[np.arange(n), y] = 1
    on = ~begins[1:]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:-1][on], y[1:][on]), 1)
    used, where = np.unique(np.concatenate([*[f for _, f in one], tri]), return_inverse=True)
    of = np.concatenate([*[w for w, _ in one], word])
    theta = [np.zeros((len(used), k)), np.zeros(k), np.zeros((k, k))]
    mean, var = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        model.weights[used] = theta[0]
        post, pairs = forward_backward(_emissions(model.weights, one, tri, word, len(seen))[kind], begins, theta[1], theta[2], pairs=True)
        err = (gold - post) / n
        # the error of a feature is that of its words, each distinct word's errors added first
        total = np.stack([np.bincount(kind, weights=err[:, j], minlength=len(seen)) for j in range(k)], axis=1)
        grad = [np.stack([np.bincount(where, weights=total[of, j], minlength=len(used)) for j in range(k)], axis=1), err[begins].sum(axis=0), (gold_pairs - pairs) / n]
        for i, g in enumerate(grad):
            g = g - ridge * theta[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            theta[i] = theta[i] + 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = theta[0]
    model.start, model.trans = theta[1], theta[2]
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on ``sample`` labelled documents of each language, those of the least hash, and the first ``sample_words`` words of each."""
    d = docs.select(row_key(id_col, text_col).alias("key"), q(text_col).alias("text"), q(lang_col).cast("string").alias("lang"))
    d = d.where("lang is not null and length(trim(text)) > 0")
    by = Window.partitionBy("lang").orderBy("key")
    keys = d.select("key", "lang").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= sample).select("key").collect()
    if not keys:
        return None
    cut = F.array_join(F.slice(F.split("text", " "), 1, sample_words), " ")
    rows = d.where(F.col("key").isin([r.key for r in keys])).select(cut.alias("text"), "lang").distinct().collect()
    return train([(r.text, r.lang) for r in rows])


def _judge(model: Model | None, min_share: float, min_known: float, min_words: int):
    """Of a text column: rows (language or None, its share, share of known words, words, switches, accepted)."""

    def run(col: pa.Array) -> Iterator[tuple[int, int, dict]]:
        for lo, hi, buf, offs in text_chunks(col, lower=True, limit=PIECE_BYTES):
            n = hi - lo
            if model is None:
                st, en, first, _ = split_words(buf, offs, WORD_BYTE)
                words = np.diff(first)
                yield lo, hi, {"lang_id": [None] * n, "share": [None] * n, "known": [None] * n, "n_words": words, "n_switches": np.zeros(n, np.int64), "accepted": words > 0}
                continue
            row, post, in_lexicon = model.posteriors(buf, offs)
            words = np.bincount(row, minlength=n)
            known = np.bincount(row, weights=in_lexicon, minlength=n) / np.maximum(words, 1)
            share = np.stack([np.bincount(row, weights=post[:, j], minlength=n) for j in range(post.shape[1])], axis=1) / np.maximum(words, 1)[:, None]
            best = share.argmax(axis=1)
            label = post.argmax(axis=1)
            turn = np.flatnonzero((label[1:] != label[:-1]) & (row[1:] == row[:-1])) + 1
            top = share[np.arange(n), best]
            yield lo, hi, {
                "lang_id": [model.labels[j] if w else None for j, w in zip(best.tolist(), words.tolist(), strict=True)],
                "share": [x if w else None for x, w in zip(np.round(top, 6).tolist(), words.tolist(), strict=True)],
                "known": [x if w else None for x, w in zip(np.round(known, 6).tolist(), words.tolist(), strict=True)], "n_words": words,
                "n_switches": np.bincount(row[turn], minlength=n), "accepted": (words > 0) & (top >= min_share) & ((known >= min_known) | (words < min_words)),
            }

    return run


def identify(docs: DataFrame, model: Model | None, min_share: float = MIN_SHARE, min_known: float = MIN_KNOWN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_id, share, known, n_words, n_switches, accepted) for every row.

    ``share`` is the expected share of the words in the language that has most, ``known`` the share of words that the lexicon holds; ``n_switches`` counts neighbouring words whose
    likeliest labels differ. Words are runs of letters, digits and underscores that hold a letter. A document is accepted if its language has ``min_share`` of its words and, if it has
    ``min_words`` words, ``min_known`` of them are known. A null or empty text, or one without words, has a null language and is not accepted. Without a model (no labelled rows)
    the language is null and a text with words is accepted. Texts are read whole, however long. Repeated rows give repeated results, an empty table an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        for lo, hi, out in _judge(shared.value, min_share, min_known, min_words)(b.column("text")):
            yield {"doc_id": b.column("doc_id").slice(lo, hi - lo), **out}

    d = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"))
    return in_arrow(run, d, "doc_id long, lang_id string, share double, known double, n_words long, n_switches long, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None, min_share: float = MIN_SHARE, min_known: float = MIN_KNOWN, min_words: int = MIN_WORDS, languages: list[str] | None = None, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The accepted documents, of the ``languages`` wanted (all labels if none are named), with the identified language in ``lang_col``, where there is such a text column; other columns stay as they are.

    Null and empty texts and texts without words go. Without a model, texts with words stay with the language they have. Repeated rows are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.lower() for c in docs.columns]
    at = names.index(text_col.lower())
    label = names.index(lang_col.lower()) if lang_col and lang_col.lower() in names and docs.schema[names.index(lang_col.lower())].dataType.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in _judge(shared.value, min_share, min_known, min_words)(b.column(at)):
                part, lang, ok = b.slice(lo, hi - lo), x["lang_id"], x["accepted"]
                if languages is not None and shared.value is not None:
                    ok = ok & np.array([v in languages for v in lang], bool)
                if label is not None and shared.value is not None:
                    part = part.set_column(label, b.schema.field(label), pa.array(lang, b.schema.field(label).type))
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(lean(run), docs.schema)


def label_spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(first word, end word, language) of the runs of equally labelled words of one text, counting words that hold a letter."""
    out: list[tuple[int, int, str]] = []
    base = 0
    for _, _, buf, offs in text_chunks(pa.array([text]), lower=True):
        _, post, _ = model.posteriors(buf, offs)
        for i, j in enumerate(post.argmax(axis=1).tolist()):
            if out and out[-1][2] == model.labels[j]:
                out[-1] = (out[-1][0], base + i + 1, model.labels[j])
            else:
                out.append((base + i, base + i + 1, model.labels[j]))
        base += len(post)
    return out
