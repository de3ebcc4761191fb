"""Joins of a table of texts with some of its rows: which rows move."""

import random
import string

import pytest
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, q, sifted
from sparkloom.llm.near_dedup import drop_near_duplicates
from sparkloom.llm.paragraph_dedup import duplicate_paragraphs
from sparkloom.llm.secret_scan import redact_secrets, scan_new

TOKEN = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.mark.parametrize(("found", "most", "extra"), [(0, 1 << 28, 0), (10, 1 << 28, 0.03), (5000, 1 << 28, 0.03), (5000, 1 << 14, 1)])
def test_no_row_is_lost(spark, found, most, extra):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 1000 == 7, None).otherwise(F.xxhash64("id")).alias("a.`key"))
    keys = durable(df.where(F.col("id") < found).select(q("a.`key").alias("h")))
    rest, maybe = sifted(df, q("a.`key"), keys, most)
    assert rest.columns == maybe.columns == df.columns
    out, held = sorted(x[0] for x in rest.collect()), {x[0] for x in maybe.collect()}
    assert sorted([*out, *held]) == list(range(20_000))
    assert held >= set(range(found)) and len(held) - found <= extra * 20_000


def shuffled(spark, df):
    """Bytes that writing ``df`` puts into shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in total().items() if k not in before)


@pytest.fixture
def many(spark, tmp_path):
    """400 texts of 10 kB, among them 20 copies and 20 with a secret; what is found counts as too much to be sent to the tasks."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(1250)) for _ in range(360)]
    texts += [t + " changed" for t in texts[:20]] + [f'{t} token = "{TOKEN}"' for t in (x[::-1] for x in texts[20:40])]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/docs")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(f"{tmp_path}/docs"), texts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_near_duplicates_go_without_moving_the_others(spark, many):
    df, texts = many
    out = drop_near_duplicates(df)
    assert shuffled(spark, out) < 0.15 * sum(map(len, texts))
    assert {x.doc_id: x.text for x in out.collect()} == {i: t for i, t in enumerate(texts) if not 360 <= i < 380}


def test_secrets_are_redacted_without_moving_the_other_texts(spark, many):
    df, texts = many
    out = redact_secrets(df, durable(scan_new(df)))
    assert shuffled(spark, out) < 0.15 * sum(map(len, texts))
    assert {x.doc_id: (x.text, x.n_chars) for x in out.collect()} == {i: (t.replace(TOKEN, "[SECRET]"), len(t.replace(TOKEN, "[SECRET]"))) for i, t in enumerate(texts)}


def records(spark):
    """Rows that each stage so far put into shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_paragraphs_without_copies_move_once(spark, tmp_path, many):
    """400 texts of 20 lines, of which 20 hold three lines of others, one of them changed: each band, and each name, is counted once, and only those of copies move again."""
    r = random.Random(5)
    line = lambda: " ".join("".join(r.choices(string.ascii_lowercase, k=7)) for _ in range(20))
    texts = [[line() for _ in range(20)] for _ in range(400)]
    for i in range(20):
        texts[380 + i][:3] = [*texts[i][:2], f"{texts[i][2]} changed"]
    spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/lines")
    before = records(spark)
    out = duplicate_paragraphs(spark.read.parquet(f"{tmp_path}/lines")).collect()
    moved = sum(n for k, n in records(spark).items() if k not in before)
    want = {(380 + i if copy else i, j, i, j, copy) for i in range(20) for j in range(3) for copy in (False, True)}
    assert {(x.doc_id, x.paragraph, x.cluster_doc, x.cluster_paragraph, x.removed) for x in out if x.kind == "line"} == want
    lines, pieces = 400 * 20, 400 * 20 * 20 / 11
    assert moved < 1.3 * (8 * lines + lines + pieces)
