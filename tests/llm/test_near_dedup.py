import random
import re

import numpy as np
import pytest

from sparkloom.llm._graph import components
from sparkloom.llm._minhash import Hasher, pack, similarity
from sparkloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from sparkloom.llm.paragraph_dedup import drop_duplicate_paragraphs, duplicate_paragraphs
from sparkloom.llm.suffix_dedup import remove_repeated


def grams(t, k):
    w = [x for x in re.findall(rb"[0-9a-z_\x80-\xff]+", (t or "").lower().encode())]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(n, near):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(30, 120))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = base[:]
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_brute_force(spark, seed):
    texts = corpus(seed)
    s = [grams(t, 3) for t in texts]
    root = groups(len(texts), lambda i, j: jaccard(s[i], s[j]) >= 0.5)
    want = {(i, root[i], i == root[i]) for i in range(len(texts)) if root.count(root[i]) > 1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(x) for x in near_duplicates(df).collect()}
    assert len(got ^ want) <= 0.1 * len(want)
    left = {x.doc_id for x in drop_near_duplicates(df).collect()}
    assert left == set(range(len(texts))) - {i for i, _, kept in got if not kept}


def test_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t, 1), (4, t, 2), (4, t, 2), (3, t + " more", 3), (5, None, 4), (6, "", 5), (7, "", 6), (8, "Hi", 7), (9, "hi!", 8), (10, "?!", 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumnRenamed("key", "loom_key")
    got = sorted((tuple(x) for x in near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (4, 3, False), (None, 3, False), (8, 8, True), (9, 8, False)], key=str)
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "-") for x in left.collect()) == sorted([(0, "-"), (3, t + " more"), (5, "-"), (6, "-"), (7, "-"), (8, "Hi"), (10, "?!")])
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


def test_similarity_is_corrected_for_collisions():
    h = Hasher(512)
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    for shared in (0, 200, 300, 400):
        b = np.concatenate([a[:shared], r.integers(0, 2**63, 400 - shared).astype(np.uint64)])
        sig = [pack(h.minima(x, np.zeros(400, np.int64))[1], 2)[0] for x in (a, b)]
        assert abs(similarity(sig[0], sig[1], 2) - shared / (800 - shared)) < 0.09


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    got = {(x.node, x.root) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == set(root.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def in_passages(paras, least=16):
    """Of (document, start, words, ...) those in a row of ``least`` words without a gap."""
    out, row = [], []
    for p in sorted(paras) + [(None, None, 0)]:
        if row and (p[0] != row[-1][0] or p[1] != row[-1][1] + row[-1][2]):
            out += row if sum(x[2] for x in row) >= least else []
            row = []
        row.append(p)
    return out


def test_paragraphs_against_brute_force(spark):
    r = random.Random(3)
    lines = [t for t in corpus(9, 30)]
    docs = ["\n".join(r.choice(lines) if r.random() < 0.6 else "short line" for _ in range(r.randint(1, 6))) for _ in range(40)]
    paras = [(d, i, t) for d, text in enumerate(docs) for i, t in enumerate(text.split("\n")) if len(t.split()) >= 25]
    s = [grams(t, 2) for _, _, t in paras]
    root = groups(len(paras), lambda i, j: jaccard(s[i], s[j]) >= 0.8)
    want = {(d, i, *paras[root[n]][:2], n != root[n]) for n, (d, i, _) in enumerate(paras) if root.count(root[n]) > 1}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(x.doc_id, x.paragraph, x.cluster_doc, x.cluster_paragraph, x.removed) for x in duplicate_paragraphs(df).where("kind = 'line'").collect()}
    assert len(got ^ want) <= 0.03 * len(want)


def test_paragraphs_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"\n\n{t}\n", 0), (1, f"\n\n{t}\n", 0), (None, t, 0), (2, None, 0), (3, "", 0), (4, f"{t}\nx\n{t}!", 0), (5, " ".join(f"z{i}" for i in range(50_000)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int")
    out = duplicate_paragraphs(df).collect()
    got = sorted(((x.doc_id, x.paragraph, x.start_word, x.n_words, x.cluster_doc, x.cluster_paragraph, x.removed) for x in out if x.kind == "line"), key=str)
    assert got == sorted([(1, 2, 0, 30, 1, 2, False), (4, 0, 0, 30, 1, 2, True), (4, 2, 31, 30, 1, 2, True), (None, 0, 0, 30, 1, 2, True)], key=str)
    pieces = [x for x in out if x.kind == "piece"]
    assert {x.doc_id for x in pieces} == {1, 4, None} and all(x.removed == (x.doc_id != 1) for x in pieces)
    assert duplicate_paragraphs(df.limit(0)).count() == 0


def test_pieces_against_brute_force(spark):
    """A passage inside a long line, and one across short lines, in other surroundings and cases; every document with one is found, and no piece that is unique."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    passage = [word() for _ in range(51)]
    docs = [" ".join(word() for _ in range(r.randint(5, 200))) for _ in range(30)]
    with_it = [" ".join([*(word() for _ in range(r.randint(0, 60))), *passage, *(word() for _ in range(r.randint(0, 60)))]) for _ in range(5)]
    with_it += ["\n".join([word(), word(), *(w.upper() for w in passage), word()]), "x y\n" + "\n".join(" ".join(passage[i : i + 4]) for i in range(0, 51, 4))]
    texts = docs + with_it
    out = duplicate_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("kind = 'piece'").collect()
    assert {x.doc_id for x in out} == set(range(30, 37))
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    seen = {}
    for x in out:
        seen.setdefault((x.cluster_doc, x.cluster_paragraph), []).append((x.doc_id, tuple(words[x.doc_id][x.start_word : x.start_word + x.n_words]), x.removed))
    for members in seen.values():
        assert len({w for _, w, _ in members}) == 1 and len(members) > 1 and sorted(gone for _, _, gone in members) == [False] + [True] * (len(members) - 1)
    # inside the passage, beyond the words that its surroundings reach, all are cut alike
    assert any({d for d, _, _ in members} == set(range(30, 37)) for members in seen.values())


def test_large_buckets_are_split(spark):
    """One signature family in one bucket, beyond the size that a task compares as a whole: the same groups as in one piece."""
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        t = base[:]
        for _ in range(r.randint(0, 25)):
            t[r.randrange(60)] = f"v{r.randrange(9999)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts + ["\n".join(texts[:3])])), "doc_id long, text string")
    one, many = ({tuple(x) for x in near_duplicates(df, block=b).collect()} for b in (10_000, 7))
    assert one == many and len({g for _, g, _ in one}) >= 1
    one, many = ({tuple(x) for x in duplicate_paragraphs(df, threshold=0.5, bands=30, width=1, block=b).collect()} for b in (10_000, 5))
    assert one == many and one


def test_hot_signature(spark):
    """Copies by the thousand are one group, whose least id stays; rows alike in id and text keep the row of the least hash, run after run."""
    df = spark.range(3000).selectExpr("id % 2000 AS doc_id", "'the same twelve words in every one of the documents of this table' AS text", "id AS other")
    left = [drop_near_duplicates(df.repartition(n)).collect() for n in (1, 3)]
    assert len(left[0]) == 1 and left[0] == left[1] and left[0][0].doc_id == 0
    assert near_duplicates(df).where("group_id = 0 and kept = (doc_id = 0)").count() == 2000


def test_short_paragraphs_against_brute_force(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 24))) for _ in range(150)]
    lines += [f"{t} {r.choice(words)}" for t in lines[:50]] + ["Released under the MIT license"]
    docs = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 6))) for _ in range(60)]
    paras = [(d, i, t) for d, text in enumerate(docs) for i, t in enumerate(text.split("\n")) if len(t.split()) >= 3]
    s = [grams(t, 2) for _, _, t in paras]
    root = groups(len(paras), lambda i, j: jaccard(s[i], s[j]) >= 0.8)
    places = [(d, sum(len(x.split()) for x in docs[d].split("\n")[:i]), len(t.split()), n) for n, (d, i, t) in enumerate(paras) if root.count(root[n]) > 1]
    rows = in_passages(places)
    assert len(rows) < len(places) and min(x[2] for x in rows) < 8
    want = {(*paras[n][:2], *paras[root[n]][:2], n != root[n]) for *_, n in rows}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(x.doc_id, x.paragraph, x.cluster_doc, x.cluster_paragraph, x.removed) for x in duplicate_paragraphs(df).where("kind = 'line'").collect()}
    assert want and len(got ^ want) <= 0.03 * len(want)


def test_removal_of_passages(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(6))
    passage, own = [word() for _ in range(60)], [[word() for _ in range(30)] for _ in range(4)]
    rows = [(i, " ".join([*own[i], *passage, "End."]), 0, 7) for i in range(3)] + [(3, " ".join(own[3]), 0, 7), (4, " ".join(passage), 0, 7), (5, None, None, 7), (6, "", 0, 7), (1, " ".join([*own[1], *passage, "End."]), 0, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, s int")
    got = {x.doc_id: x for x in remove_repeated(df).collect()}
    assert set(got) == {0, 1, 2, 3, 5, 6} and got[0].text == rows[0][1] and got[5].text is None and got[6].text == ""
    # the anchor of a copy may reach no farther than its last whole window: here the last word goes along, as it is the same
    assert all(got[i].text == " ".join(own[i]) and got[i].n_chars == len(got[i].text) for i in (1, 2))
    left = {x.doc_id: x.text for x in drop_duplicate_paragraphs(df).collect()}
    assert left[0] == rows[0][1] and left[3] == rows[3][1] and left[5] is None
    for i in (1, 2):
        words = left[i].split()
        assert words[:30] == own[i] and len(words) < 30 + 25
    assert len((left.get(4) or "").split()) < 40 and remove_repeated(df.limit(0)).count() == 0 and drop_duplicate_paragraphs(df.limit(0)).count() == 0
