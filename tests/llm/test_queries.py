import os
import random

import numpy as np
import pytest

from sparkloom.llm import queries
from sparkloom.llm._common import WORD_BYTE, hash_words, split_words
from sparkloom.llm._common import grams as hashed_grams
from sparkloom.llm.mixing import TARGETS
from sparkloom.llm.secret_scan import RULES, Scanner
from tests.llm.test_html_extract import brute as differenced
from tests.llm.test_html_extract import page
from tests.llm.test_mixing import raking
from tests.llm.test_near_dedup import corpus, grams, groups, in_passages, jaccard
from tests.llm.test_pipeline import SCHEMA, TOKEN, prose
from tests.oracle import connect, differences

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == []


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


@pytest.fixture
def documents(spark, tmp_path):
    """(rows, folder) of a small table of documents; the queries run on it as they are."""
    r = random.Random(11)
    rows = []
    for i, t in enumerate(corpus(3, 25)):
        rows.append((i, t, "en", r.choice(["a", "b", "b"]), len(t)))
    for i in range(100, 130):
        lang = r.choice(["en", "fr"])
        t = "\n".join(prose(r, lang, r.randint(26, 40)) for _ in range(3)) + (f"\n{TOKEN}" if i % 5 == 0 else "") + (f"\n{rows[2][1]}" if i % 6 == 0 else "")
        rows.append((i, t, lang, r.choice(["a", "c"]), len(t)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return rows, str(tmp_path)


def test_op2(spark, documents):
    rows, folder = documents
    s = [grams(x[1], 3) for x in rows]
    root = groups(len(rows), lambda i, j: jaccard(s[i], s[j]) >= 0.5)
    want = {(rows[i][0], rows[root[i]][0], i == root[i]) for i in range(len(rows)) if root.count(root[i]) > 1}
    got = {tuple(x) for x in queries.QUERIES["op2_minhash_near_dedup"](spark, folder).collect()}
    assert want and len(got ^ want) <= 0.05 * len(want)


def test_op3(spark, documents):
    rows, folder = documents
    paras = [(x[0], i, t) for x in rows for i, t in enumerate(x[1].split("\n")) if len(t.split()) >= 25]
    s = [grams(t, 2) for _, _, t in paras]
    root = groups(len(paras), lambda i, j: jaccard(s[i], s[j]) >= 0.8)
    want = {(d, i, *paras[root[n]][:2], n != root[n]) for n, (d, i, _) in enumerate(paras) if root.count(root[n]) > 1}
    out = queries.QUERIES["op3_paragraph_dedup"](spark, folder).collect()
    got = {(x.doc_id, x.paragraph, x.cluster_doc, x.cluster_paragraph, x.removed) for x in out if x.kind == "line"}
    assert want and len(got ^ want) <= 0.05 * len(want)
    # pieces: cut word by word, then told apart by their words
    seen: dict = {}
    for i, t, *_ in rows:
        raw = t.lower().encode()
        st, en, _, m = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD_BYTE)
        g = [x >> 1 for x in hashed_grams(hash_words(np.frombuffer(raw, np.uint8), st, en, m), 2).tolist()] + [2**64]
        at = [0] + [j for j in range(1, len(g) - 1) if all(g[j] < x for x in g[max(0, j - 5) : j]) and all(g[j] <= x for x in g[j + 1 : j + 6])]
        words = [raw[x:y] for x, y in zip(st, en, strict=True)]
        for n, (lo, hi) in enumerate(zip(at, [*at[1:], len(words)], strict=True)):
            if hi - lo >= 6:
                seen.setdefault(tuple(words[lo:hi]), []).append((i, n, lo, hi - lo))
    copied = [(p[0], *p[2:], p[1], *places[0][:2], p != places[0]) for places in seen.values() if len(places) > 1 for p in places]
    want = {(i, n, *x) for i, lo, size, n, *rest in in_passages(copied) for x in [(lo, size, *rest)]}
    assert want and {(x.doc_id, x.paragraph, x.start_word, x.n_words, x.cluster_doc, x.cluster_paragraph, x.removed) for x in out if x.kind == "piece"} == want


def test_op5(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, f"http://h{i % 3}.com/{r.randint(1, 40)}", page("menu", *[r.choice(["shared", f"own {i} {j}"]) for j in range(5)], "foot")) for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(x) for x in queries.QUERIES["op5_html_extraction"](spark, str(tmp_path)).collect()), key=str) == differenced(rows)


def test_op6(spark, documents):
    rows, folder = documents
    got = {x.doc_id: x for x in queries.QUERIES["op6_language_id"](spark, folder).collect()}
    assert set(got) == {x[0] for x in rows} and all(got[x[0]].lang_id == x[2] and got[x[0]].accepted for x in rows if x[0] >= 100 and x[0] % 6)


def test_op8(spark, documents):
    rows, folder = documents
    # the first instalment has a text of the second one, and a secret of its own
    talk = [(1, 1, "user", next(x[1] for x in rows if TOKEN in x[1])), (1, 2, "user", f"mine is {TOKEN}"), (2, 1, "user", None)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    scanner = Scanner(RULES)
    want = {(x[3], x[0], *f) for x in rows for f in scanner.scan(x[1])}
    got = {(x.source, x.doc_id, x.rule, x.start, x.end, x.digest) for x in queries.QUERIES["op8_secret_scan"](spark, folder).collect()}
    assert got == want and len(want) == 6


def test_op10(spark, documents):
    rows, folder = documents
    data = [(x[0], x[1], x[3], x[2]) for x in rows]
    goal = []
    for name, c in (("source", 2), ("lang", 3)):
        total: dict = {}
        for x in data:
            total[x[c]] = total.get(x[c], 0) + len(x[1].split())
        goal.append((c, {k: v ** TARGETS[name] / sum(w ** TARGETS[name] for w in total.values()) for k, v in total.items()}))
    t, rate = raking(data, goal)
    got = {x.doc_id: x for x in queries.QUERIES["op10_mixing"](spark, folder).collect()}
    for x, n, want in zip(data, t, rate / rate.min(), strict=True):
        assert got[x[0]].tokens == n and abs(got[x[0]].rate - want) < 1e-6 * want and got[x[0]].copies >= 1
