"""The pipeline against a version of each stage in plain Python, and on awkward documents."""

import random

import pyarrow as pa

import corpus_pipeline
from sparkloom.llm.language_id import _judge, train
from sparkloom.llm.secret_scan import RULES, Scanner, redact
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_decontaminate import words
from tests.llm.test_mixing import raking
from tests.llm.test_near_dedup import grams, groups, jaccard

SYLLABLES = {"en": ["the", "ing", "and", "tion", "er", "whi"], "fr": ["eau", "que", "ille", "ré", "oux", "ment"]}
TOKEN = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(r):
    item = prose(r, "en", 20)
    rows = []
    for i in range(40):
        lang = r.choice(["en", "fr"])
        t = prose(r, lang, r.randint(30, 90))
        if i % 7 == 0:
            t += " " + item
        if i % 9 == 0:
            t += f" {TOKEN} " + prose(r, lang, 5)
        rows.append((i, t, lang, r.choice(["a", "a", "b"]), len(t)))
    for i in range(40, 50):
        t = rows[i - 40][1].split()
        t[3] = "changed"
        rows.append((i, " ".join(t), *rows[i - 40][2:]))
    rows += [(50, "12 34 !!", "en", "a", 8), (51, rows[1][1], *rows[1][2:])]
    return rows, item


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_plain_python(spark, tmp_path):
    rows, item = corpus(random.Random(8))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # language ID
    model = train(sorted({(x[1], x[2]) for x in rows}))
    ok = next(_judge(model, 0.5, 0.1, 10)(pa.array([x[1] for x in rows])))[2]["accepted"]
    docs = [x for x, keep in zip(rows, ok, strict=True) if keep]
    assert 50 not in {x[0] for x in docs}
    # near duplicates
    s = [grams(x[1], 3) for x in docs]
    root = groups(len(docs), lambda i, j: jaccard(s[i], s[j]) >= 0.5)
    docs = [x for i, x in enumerate(docs) if root[i] == i]
    # decontamination: no match is left, and only matches went
    assert set(got) == {x[0] for x in docs}
    for x in docs:
        found = leaks([(x[0], x[1])], [(1, item)], 13, 0.6, 8)
        gone = sum(f[3] for f in found)
        text = got[x[0]].text
        assert not leaks([(0, text)], [(1, item)], 13, 0.6, 8)
        clean = redact(x[1], Scanner(RULES).scan(x[1]))
        assert len(words(text)) == len(words(clean)) - gone
        assert got[x[0]].n_chars == len(text) and TOKEN not in text
        if not found:
            assert text == clean
    # mixing: the margins meet their targets
    left = [(i, got[i].text, got[i].source, got[i].lang) for i in sorted(got)]
    total = {c: {} for c in (2, 3)}
    for x in left:
        for c in (2, 3):
            total[c][x[c]] = total[c].get(x[c], 0) + len(x[1].split())
    goal = {c: {k: v**p / sum(w**p for w in total[c].values()) for k, v in total[c].items()} for c, p in ((2, 0.5), (3, 0.75))}
    t, rate = raking(left, list(goal.items()))
    for x, n, want in zip(left, t, rate / rate.min(), strict=True):
        assert got[x[0]].tokens == n and abs(got[x[0]].rate - want) < 1e-6 * want
        assert got[x[0]].copies - int(got[x[0]].rate) in (0, 1)


def test_awkward_documents(spark, tmp_path):
    r = random.Random(2)
    long = prose(r, "en", 60_000) + f" {TOKEN}"
    rows = [(None, prose(r, "en", 40), None, None, None, 1), (1, None, "en", "a", None, 1), (2, "", "en", "a", 0, 1), (3, long, "en", None, len(long), None), (3, long, "en", None, len(long), None), (4, prose(r, "fr", 50), "fr", "a", 3, 1), (4, prose(r, "fr", 50), "fr", "a", 3, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", tokens int").withColumnRenamed("tokens", "copies")
    df.write.parquet(f"{tmp_path}/x/documents.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/x/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/x")
    assert got.columns == [*df.columns, "tokens", "rate", "copies_"]
    assert sorted(str(x.doc_id) for x in got.collect()) == ["3", "4", "4", "None"]
    df.limit(0).write.parquet(f"{tmp_path}/y/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/y/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/y").count() == 0


def test_stages_keep_columns(spark, tmp_path):
    rows, item = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
