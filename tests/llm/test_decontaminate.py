import random
import re

import numpy as np
import pytest

from sparkloom.llm.decontaminate import Automaton, contaminated_spans, remove_contamination


def words(t):
    return re.findall(rb"[0-9a-z_\x80-\xff]+", (t or "").lower().encode())


def brute(docs, items, max_words, max_coverage, min_words):
    items = [(i, words(t)) for i, t in items if words(t)]
    subs = {}
    for i, w in items:
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                k = tuple(w[a:b])
                subs[k] = min(subs.get(k, (10**9, 0)), (len(w), i))
    out = []
    for d, t in docs:
        w = words(t)
        spans = []
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                size, _ = subs.get(tuple(w[a:b]), (0, 0))
                if size and (b - a >= max_words or (b - a >= min_words and b - a >= max_coverage * size)):
                    spans.append((a, b))
        for a, b in spans:
            if not any((x, y) != (a, b) and x <= a and b <= y for x, y in spans):
                size, i = subs[tuple(w[a:b])]
                out.append((d, a, b, b - a, i, (b - a) / size))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(6 if seed % 2 else 40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 15)))) for i in range(12)]
    items += [(20, items[0][1]), (21, ""), (22, None)]
    docs = []
    for i in range(40):
        t = []
        for _ in range(r.randint(0, 4)):
            w = r.choice(items)[1] or ""
            t += (w.split()[: r.randint(1, 15)] if r.random() < 0.5 else [r.choice([*vocab, "Other,"]) for _ in range(r.randint(1, 10))])
        docs.append((i, " ".join(t).upper() if r.random() < 0.3 else "\n".join(t)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (3, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 7, 0.6, 3)
    # one automaton, and several of a few items each
    for shard in (1_000_000, 20):
        assert sorted((tuple(x) for x in contaminated_spans(d, b, 7, 0.6, 3, shard_words=shard).collect()), key=str) == want


def test_a_covered_item_inside_a_longer_passage_of_another_item(spark):
    short = " ".join(f"w{i}" for i in range(9))
    long = " ".join([*(f"x{i}" for i in range(20)), short, "y", *(f"z{i}" for i in range(20))])
    docs = spark.createDataFrame([(1, f"before {short} y after")], "doc_id long, text string")
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    assert [tuple(x) for x in contaminated_spans(docs, items).collect()] == [(1, 1, 10, 9, 1, 1.0)]


def test_size_of_the_automaton():
    """About 90 bytes a word."""
    import io

    r = random.Random(1)
    h = np.array([r.randrange(1, 3000) for _ in range(20_000)], np.uint64)
    f = io.BytesIO()
    Automaton([(i, h[i : i + 50]) for i in range(0, len(h), 50)]).to_file(f)
    assert len(f.getvalue()) < 100 * len(h)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [
        (1, "Before it. One two, three four five six seven eight nine ten! after İt", 70, 1),
        (2, item, 48, 2), (3, "clean text", 10, 3), (4, None, None, 4), (5, "", 0, 5), (2, item, 48, 2),
        (6, "İİ one two three four five six seven eight nine ten é " + "word " * 30_000, 1, 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, item long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {x.doc_id: x for x in remove_contamination(df, bench).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert got[1].text == "Before it. ! after İt" and got[1].n_chars == len(got[1].text) and got[1].item == 1
    assert (got[3].text, got[3].n_chars, got[4].text, got[4].n_chars, got[5].text) == ("clean text", 10, None, None, "")
    assert got[6].text.startswith("İİ é word word")
    assert contaminated_spans(df.limit(0), bench).count() == 0
    assert contaminated_spans(df, bench.limit(0)).count() == 0
    assert remove_contamination(df, bench.limit(0)).count() == len(rows)
