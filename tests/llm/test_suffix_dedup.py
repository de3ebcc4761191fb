import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm.suffix_dedup import blind_trie, repeated_passages, shallow_sort, suffix_sort


def brute(rows, length):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    where = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        w = (t or "").split()
        for p in range(len(w) - length + 1):
            where[tuple(w[p : p + length])].append((i, p))
    out = []
    for role in ("repeated", "remove"):
        cover = defaultdict(set)
        for places in where.values():
            if len(places) > 1:
                for i, p in places if role == "repeated" else sorted(places)[1:]:
                    cover[i].update(range(p, p + length))
        for i, c in cover.items():
            for x in sorted(c):
                if x - 1 not in c:
                    y = x
                    while y in c:
                        y += 1
                    out.append((rows[i][0], role, x, y, y - x))
    return sorted(out, key=str)


def run(spark, rows, length, schema="doc_id long, text string"):
    got = repeated_passages(spark.createDataFrame(rows, schema), length).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[r.choice(words) for _ in range(r.randint(6, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(r.randint(0, 5)):
            t += r.choice(passages) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 30))]
            if r.random() < 0.2:
                t[r.randrange(len(t))] = "edit"
        rows.append((i, " ".join(t)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a b " * 30), (103, "x " * 25)]
    for length in (8, 11):
        assert run(spark, rows, length) == brute(rows, length)


def test_odd_rows(spark):
    t = " ".join(f"q{i}" for i in range(12))
    rows = [(None, t), (1, t), (1, t), (2, None), (3, ""), (4, "   \n "), (None, None), (5, "é " + t + " ñ"), (6, " ".join(f"z{i}" for i in range(40_000)))]
    assert run(spark, rows, 8) == brute(rows, 8)
    assert run(spark, [(1, t), (1, t)], 8) == []
    assert run(spark, [], 8) == []


def test_clashing_columns(spark):
    t = " ".join(f"q{i}" for i in range(12))
    rows = [(1, t, 5, "x", 1), (2, t, 6, "y", 2)]
    got = run(spark, rows, 8, "doc_id long, text string, key int, h string, pos int")
    assert got == brute([(1, t), (2, t)], 8)


def test_texts_move_once(spark):
    # anchors, their documents, texts, contexts, passages
    t = " ".join(f"q{i}" for i in range(12))
    rows = [(None, t), (None, t), (1, t), (1, t), (None, f"{t} z"), (0, f"{t} z")]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 8)


def test_sorting():
    r = np.random.default_rng(0)
    for n, symbols in ((1, 2), (50, 2), (500, 3), (500, 50)):
        s = r.integers(1, symbols + 1, (n, 9)).astype(np.uint64)
        order, lcp = suffix_sort(s, 3)
        rows = [tuple(x) for x in s[order].tolist()]
        assert rows == sorted(rows)
        for i in range(1, n):
            same = 0
            while same < 9 and rows[i][same] == rows[i - 1][same]:
                same += 1
            assert lcp[i] == same
        order, deep = shallow_sort(s, 2)
        assert sorted(order.tolist()) == list(range(n))
    order, lcp = blind_trie([b"ab", b"aa", b"ab"], 1)
    assert (order, lcp) == ([1, 0, 2], [0, 1, 2])
