import itertools
import math
import random
import re

import numpy as np
import pytest

from sparkloom.llm.language_id import _HASHED, fit, forward_backward, identify, keep_identified, label_spans, train

WORDS = {"aa": ["kata", "malo", "tirra", "pelka", "sano"], "bb": ["schtu", "wunz", "grech", "holbt", "unt"], "cc": ["ñuea", "çoirè", "élan", "vaux", "où"]}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", r.choice(WORDS[lang])]) for _ in range(n))


@pytest.mark.parametrize("n", [1, 4, 9])
def test_forward_backward_against_enumeration(n):
    r = np.random.default_rng(n)
    k = 3
    score, start, trans = r.normal(size=(n, k)), r.normal(size=k), r.normal(size=(k, k))
    begins = r.random(n) < 0.3
    begins[0] = True
    want, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n) if n < 9 else itertools.product(range(k), repeat=n):
        p = np.exp(sum(score[i, y[i]] + (start[y[i]] if begins[i] else trans[y[i - 1], y[i]]) for i in range(n)))
        total += p
        for i in range(n):
            want[i, y[i]] += p
            if i and not begins[i]:
                pairs[y[i - 1], y[i]] += p
    got, got_pairs = forward_backward(score.astype(np.float32), begins, start, trans, pairs=True)
    assert np.allclose(got, want / total, atol=1e-5)
    assert np.allclose(got_pairs, pairs / total, atol=1e-5)


def test_long_chains_pass_blocks():
    r = np.random.default_rng(1)
    score, start, trans = r.normal(size=(1000, 3)), r.normal(size=3), r.normal(size=(3, 3))
    begins = np.zeros(1000, bool)
    begins[[0, 130, 640]] = True
    got, _ = forward_backward(score, begins, start, trans)
    for lo, hi in ((0, 130), (130, 640), (640, 1000)):
        a = np.zeros((hi - lo, 3))
        b = np.ones((hi - lo, 3))
        for i in range(hi - lo):
            a[i] = np.exp(score[lo + i]) * (np.exp(start) if i == 0 else a[i - 1] @ np.exp(trans))
            a[i] /= a[i].sum()
        for i in range(hi - lo - 2, -1, -1):
            b[i] = np.exp(trans) @ (np.exp(score[lo + i + 1]) * b[i + 1])
            b[i] /= b[i].sum()
        p = a * b
        assert np.allclose(got[lo:hi], p / p.sum(axis=1, keepdims=True), atol=1e-6)


def test_held_out_and_switches():
    r = random.Random(1)
    model = train([(text(r, lang, 40), lang) for lang in WORDS for _ in range(12)])
    right = total = 0
    for lang in WORDS:
        for _ in range(10):
            spans = label_spans(text(r, lang, 20), model)
            right += sum(b - a for a, b, x in spans if x == lang)
            total += 20
    assert right / total > 0.97
    mixed = text(r, "aa", 15) + " " + text(r, "bb", 15)
    spans = label_spans(mixed, model)
    assert spans[0][2] == "aa" and spans[-1][2] == "bb" and abs(spans[-1][0] - 15) <= 2


def test_rows(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang, 30), lang, 1) for i, lang in enumerate(list(WORDS) * 6)]
    rows += [(100, None, "aa", 1), (101, "", "aa", 1), (102, "12 345 !!", "bb", 1), (103, "kata malo", None, 1), (None, "wunz grech", None, 1), (0, *rows[0][1:]), (104, "sano " * 60_000, "aa", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share int")
    model = fit(df, sample=5)
    got = {x.doc_id: x for x in identify(df, model).collect()}
    assert all(got[i].lang_id == rows[i][2] and got[i].accepted for i in range(18))
    assert [got[i].accepted for i in (100, 101, 102, 103, None, 104)] == [False, False, False, True, True, True]
    assert (got[100].lang_id, got[100].n_words, got[103].lang_id, got[None].lang_id, got[104].n_words) == (None, 0, "aa", "bb", 60_000)
    left = keep_identified(df, model)
    assert left.columns == df.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(x[0]) for x in rows if x[0] not in (100, 101, 102))
    assert fit(df.limit(0)) is None and identify(df.limit(0), None).count() == 0
    assert {x.doc_id for x in keep_identified(df, None).collect()} == {x[0] for x in rows if x[0] not in (100, 101)}


def splitmix(x):
    m = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def plain(model, lexicon_words, text):
    """(language, share, known, words, switches) word by word in plain Python: features one at a time, then forward-backward with logarithms."""
    words = [w for w in re.findall(rb"[0-9a-z_\x80-\xff]+", (text or "").lower().encode()) if re.search(rb"[a-z\x80-\xff]", w)]
    k = len(model.labels)
    if not words:
        return None, None, None, 0, 0
    score = []
    for w in words:
        f = [splitmix(int.from_bytes(x, "big") + ((2 * n + side) << 40)) % _HASHED for n in (1, 2, 3, 4) if len(w) >= n for side, x in ((0, w[:n]), (1, w[-n:]))]
        f += [splitmix(int.from_bytes(w[i : i + 3], "big") + (1 << 50)) % _HASHED for i in range(len(w) - 2)]
        f += [_HASHED + lexicon_words[w]] if w in lexicon_words else []
        score.append([float(sum(model.weights[x][j] for x in f)) for j in range(k)])
    total = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    a = [[model.start[j] + score[0][j] for j in range(k)]]
    for s in score[1:]:
        a.append([s[j] + total([a[-1][i] + model.trans[i][j] for i in range(k)]) for j in range(k)])
    b = [[0.0] * k]
    for s in score[:0:-1]:
        b.insert(0, [total([model.trans[j][i] + s[i] + b[0][i] for i in range(k)]) for j in range(k)])
    post = [[math.exp(x + y - total([p + q for p, q in zip(u, v)])) for x, y in zip(u, v)] for u, v in zip(a, b)]
    share = [sum(p[j] for p in post) / len(words) for j in range(k)]
    label = [max(range(k), key=p.__getitem__) for p in post]
    return model.labels[max(range(k), key=share.__getitem__)], max(share), sum(w in lexicon_words for w in words) / len(words), len(words), sum(x != y for x, y in zip(label, label[1:]))


def test_against_plain_python(spark):
    from sparkloom.llm._common import WORD_BYTE, hash_words, split_words

    r = random.Random(12)
    model = train([(text(r, lang, 40), lang) for lang in WORDS for _ in range(8)])
    vocabulary = sorted({w for x in WORDS.values() for a in x for w in (a, *(a + b for b in x))})
    raw = " ".join(vocabulary).encode()
    buf = np.frombuffer(raw, np.uint8)
    st, en, _, m = split_words(buf, np.array([0, len(raw)]), WORD_BYTE)
    lexicon = {x: i for i, x in enumerate(model.lexicon.tolist())}
    lexicon_words = {w.encode(): lexicon[h] for w, h in zip(vocabulary, hash_words(buf, st, en, m).tolist(), strict=True) if h in lexicon}
    docs = [" ".join(text(r, r.choice(list(WORDS)), r.randint(1, 9)) + r.choice(["", ",", " 12", "\nKATA", " xqzz"]) for _ in range(r.randint(1, 5))) for _ in range(30)]
    docs += ["qwrtp zzxy " * 10, "", "99 !", "kata"]
    got = {x.doc_id: x for x in identify(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(docs):
        lang, share, known, n, switches = plain(model, lexicon_words, t)
        assert (got[i].lang_id, got[i].n_words, got[i].n_switches) == (lang, n, switches)
        assert got[i].accepted == (n > 0 and share >= 0.5 and (known >= 0.1 or n < 10))
        if n:
            assert abs(got[i].share - share) < 1e-4 and abs(got[i].known - known) < 1e-5
    assert not got[30].accepted


def test_languages_wanted_and_labels_set(spark):
    r = random.Random(3)
    rows = [(i, text(r, lang, 30), lang) for i, lang in enumerate(list(WORDS) * 4)]
    model = train([(t, lang) for _, t, lang in rows])
    df = spark.createDataFrame([(i, t, None if i % 2 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert {(x.doc_id, x.lang) for x in keep_identified(df, model, languages=["aa", "cc"]).collect()} == {(i, lang) for i, _, lang in rows if lang != "bb"}
