import numpy as np
import pytest

from sparkloom.llm.topk_search import Boxes, Search, statistics, top_k


def brute(rows, k):
    rows = list({(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values())
    rows = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(rows):
        near = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 12), j is None, j or 0, j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))
        out += [(i, r + 1, x[3], round(x[0], 6)) for r, x in enumerate(near[:k])]
    return sorted(out, key=str)


def run(spark, rows, k, every=1, **kw):
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    return sorted((tuple(x) for x in top_k(df, k, every, **kw).collect()), key=str)


@pytest.mark.parametrize("dim,block", [(16, 40), (5, 1000)])
def test_against_brute_force(spark, dim, block):
    r = np.random.default_rng(dim)
    centres = r.normal(size=(6, dim)) * 3
    x = (centres[r.integers(0, 6, 150)] + r.normal(size=(150, dim)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 4, block=block, together=20) == brute(rows, 4)
    assert run(spark, rows, 4, every=7, block=block) == [x for x in brute(rows, 4) if x[0] % 7 == 0]


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 2.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, 1.0, 1.0]), (8, [None, 1.0]), (9, [5.0, 5.0])]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [(1, [1.0])], 3) == []
    assert run(spark, [], 3) == []


def test_statistics_bound_distances():
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 30))
    true = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    last = np.zeros_like(true)
    for n in (1, 2, 5, 30):
        s = statistics(x, n)
        bound = ((s[:, None] - s[None]) ** 2).sum(axis=2)
        assert (bound <= true + 1e-9).all()
        last = bound
    assert np.allclose(last, true)


def test_coarse_bounds_spare_fine_ones_and_distances():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32)) * 3
    x = centres[np.repeat(np.arange(40), 50)] + r.normal(size=(2000, 32)) * 0.1
    node = np.arange(2000)
    d = np.sqrt(((x[::40, None] - x[None]) ** 2).sum(axis=2))
    d[np.arange(50), node[::40]] = np.inf
    # with no bound at first, and with that of the own block
    for tau, share in ((np.full(50, np.inf), 0.6), (np.sort(d, axis=1)[:, 4], 0.03)):
        s = Search(x[::40], node[::40], tau, 5, (4, 16))
        for at in range(0, 2000, 100):
            s.see(x[at : at + 100], node[at : at + 100], np.zeros(100, bool), node[at : at + 100], node[at : at + 100])
        assert (s.id == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
        assert s.looked[0] < 0.6 * 50 * 2000 and s.looked[1] < 0.1 * 50 * 2000 and s.looked[2] < share * 50 * 2000, s.looked


def test_tree_of_boxes_gives_all_near_blocks():
    r = np.random.default_rng(4)
    lo = r.random((90, 3))
    hi = lo + r.random((90, 3)) * 0.1
    boxes = Boxes(np.arange(90), np.full(90, 7), lo, hi)
    for _ in range(20):
        a = r.random(3)
        b = a + 0.05
        gap = (np.maximum(np.maximum(lo - b, a - hi), 0) ** 2).sum(axis=1)
        at, g = boxes.near(7, a, b, 0.05)
        assert set(at) == set(np.flatnonzero(gap <= 0.05)) and (np.diff(g) >= 0).all()
