import random

import numpy as np
import pytest

from sparkloom.llm.mixing import with_rates


def raking(rows, margins, rounds=2000):
    """Iterative proportional fitting, which has the same solution."""
    t = np.array([len((x[1] or "").split()) for x in rows], float)
    rate = np.ones(len(rows))
    for _ in range(rounds):
        for col, goal in margins:
            level = [x[col] for x in rows]
            total = (t * rate).sum()
            for v, share in goal.items():
                on = np.array([y == v for y in level])
                rate[on] *= share * total / (t * rate)[on].sum()
    return t, rate


def test_against_raking(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 50), r.choice(["a", "a", "a", "b", "c"]), r.choice(["x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    goals = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.7, "y": 0.3}}
    t, rate = raking(rows, [(2, goals["source"]), (3, goals["lang"])])
    got = {x.doc_id: x for x in with_rates(df, goals).collect()}
    assert [got[i].tokens for i in range(300)] == t.tolist()
    mine = np.array([got[i].rate for i in range(300)])
    assert np.allclose(mine, rate / rate.min(), rtol=1e-6)
    assert all(got[i].copies in (int(mine[i]), int(mine[i]) + 1) and got[i].copies >= 1 for i in range(300))
    fixed = np.array([x.rate for x in with_rates(df, goals, total_tokens=5000).orderBy("doc_id").collect()])
    assert (t * fixed).sum() == pytest.approx(5000, rel=1e-6)


def test_copies_are_unbiased(spark):
    rows = [(i, "a b c", "s" if i % 3 else "r") for i in range(3000)]
    got = with_rates(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"source": {"s": 0.5, "r": 0.5}}).collect()
    assert abs(sum(x.copies for x in got) / sum(x.rate for x in got) - 1) < 0.02


def test_odd_rows(spark):
    rows = [(1, "a b", None, 1), (2, "c d e", "s", 1), (None, None, "s", 1), (4, "", "gone", 1), (2, "c d e", "s", 1), (5, "w " * 100_000, "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x0 int")
    got = sorted(with_rates(df, {"source": 1.0}).collect(), key=str)
    assert len(got) == 6
    assert {(x.doc_id, x.tokens, x.rate) for x in got} == {(1, 2, 1.0), (2, 3, 1.0), (None, 0, 1.0), (4, 0, 0.0), (5, 100_000, 1.0)}
    some = with_rates(df, {"source": {"s": 1.0, "absent": 3.0}}).collect()
    assert {(x.source, x.copies) for x in some} == {(None, 0), ("s", 1), ("gone", 0), ("big", 0)}
    assert with_rates(df.limit(0), {"source": 0.5}).count() == 0
    assert with_rates(df.withColumnRenamed("x0", "rate"), {"source": 0.5}).columns == ["doc_id", "text", "source", "rate", "tokens", "rate_", "copies"]


def test_many_levels_by_conjugate_gradients(spark, monkeypatch):
    from sparkloom.llm import mixing

    r = random.Random(4)
    rows = [(i, "w " * r.randint(1, 9), f"s{r.randrange(40)}", r.choice("xyz")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    dense = {x.doc_id: x.rate for x in with_rates(df).collect()}
    monkeypatch.setattr(mixing, "DENSE", 5)
    sparse = {x.doc_id: x.rate for x in with_rates(df).collect()}
    assert all(abs(dense[i] - sparse[i]) < 1e-6 * dense[i] for i in dense)


def test_many_thousand_levels(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 3 AS int)) AS text", "id % 5000 AS source", "cast(floor(id / 5000) % 2 AS string) AS lang")
    got = with_rates(df, {"source": 0.5, "lang": {"0": 0.7, "1": 0.3}}).selectExpr("sum(tokens * rate) AS all", "sum(tokens * rate) FILTER (WHERE lang = '0') AS zero", "min(rate) AS least").first()
    assert abs(got["zero"] / got["all"] - 0.7) < 1e-6 and abs(got["least"] - 1) < 1e-9


def test_clashing_names(spark):
    rows = [(1, "a b", "s", 1, 2), (2, "c d e", "t", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __t string, loom_t int, loom_x0 int")
    got = with_rates(df, {"__t": 0.0})
    assert got.columns == [*df.columns, "tokens", "rate", "copies"] and {(x.doc_id, round(x.rate, 6)) for x in got.collect()} == {(1, 1.5), (2, 1.0)}
