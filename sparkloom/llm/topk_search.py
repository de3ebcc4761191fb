"""Exact nearest neighbours by multi-resolution segment statistics.

A vector is cut into segments. With l values a segment, means m and deviations s, the sum of l * ((m - m')^2 + (s - s')^2) over the segments bounds the squared Euclidean
distance from below, and finer cuts bound it better. Vectors lie in blocks of near coarse statistics. Each query first searches its own block, which bounds its k-th
distance; a tree of the blocks' boxes gives the blocks that can hold anything nearer. These stream past the queries nearest first while the k-th distance shrinks: coarse
bounds are taken for all, finer ones and at last exact distances for the pairs that survive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, in_arrow, q

#: Neighbours of each query.
K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Segments at each resolution, coarse to fine.
LEVELS = (4, 16)
#: Vectors of a block, and the most blocks there are (blocks grow beyond that): their boxes, some 150 bytes each, are sent to every task.
BLOCK, MAX_BLOCKS = 8192, 100_000
#: Queries that go through the blocks together, and blocks that go past them in one task.
TOGETHER, STRIPE = 2048, 2
_SLACK = 1e-9


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of the segments: the squared distance of two rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    return np.concatenate([np.stack([x[:, p].mean(axis=1), x[:, p].std(axis=1)], axis=1) * math.sqrt(len(p)) for p in parts], axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _limit(tau: np.ndarray) -> np.ndarray:
    return tau**2 * (1 + _SLACK) + _SLACK


class Search:
    """Queries whose k nearest are kept while rows stream past. ``tau`` bounds each one's k-th distance from above."""

    def __init__(self, x: np.ndarray, node: np.ndarray, tau: np.ndarray, k: int, levels: tuple[int, ...]):
        self.x, self.node, self.tau, self.k = x, node, tau.copy(), k
        self.levels = [(n, statistics(x, n)) for n in levels]
        # of the k nearest: distance, whether there is no id, id, number by content, node
        self.d = np.full((len(x), k), np.inf)
        self.none, self.id = np.ones((len(x), k), bool), np.zeros((len(x), k), np.int64)
        self.key, self.of = np.zeros((len(x), k), np.int64), np.full((len(x), k), -1, np.int64)
        #: pairs at which each level was looked, and the exact distances taken
        self.looked = np.zeros(len(levels) + 1, np.int64)

    def see(self, y: np.ndarray, node: np.ndarray, none: np.ndarray, ident: np.ndarray, key: np.ndarray) -> None:
        limit = _limit(self.tau)
        row, col = np.arange(len(self.x)), None
        for at, (n, s) in enumerate(self.levels):
            t = statistics(y, n)
            if col is None:
                # queries that the box of these rows is too far from are done
                gap = (np.maximum(np.maximum(s[row] - t.max(axis=0), t.min(axis=0) - s[row]), 0) ** 2).sum(axis=1)
                row = row[gap <= limit[row]]
                self.looked[at] += len(row) * len(y)
                i, col = np.nonzero(_squares(s[row], t) <= limit[row, None] + _SLACK)
                row = row[i]
            elif len(col) < 0.3 * len(self.x) * len(y):
                self.looked[at] += len(col)
                near = np.concatenate([((s[row[a : a + 200_000]] - t[col[a : a + 200_000]]) ** 2).sum(axis=1) for a in range(0, len(col), 200_000)] or [np.empty(0)])
                ok = near <= limit[row] + _SLACK
                row, col = row[ok], col[ok]
        if col is None:
            row, col = np.repeat(row, len(y)), np.tile(np.arange(len(y)), len(row))
        ok = self.node[row] != node[col]
        row, col = row[ok], col[ok]
        self.looked[-1] += len(col)
        if not len(col):
            return
        if len(col) > 0.05 * len(self.x) * len(y):
            d = _squares(self.x, y)[row, col]
        else:
            d = np.concatenate([((self.x[row[a : a + 100_000]] - y[col[a : a + 100_000]]) ** 2).sum(axis=1) for a in range(0, len(col), 100_000)])
        ok = d <= limit[row]
        row, col, d = row[ok], col[ok], d[ok]
        for i, lo, hi in self._spans(row):
            c, e = col[lo:hi], d[lo:hi]
            if len(c) > self.k:
                top = np.partition(e, self.k - 1)[self.k - 1]
                c = c[e <= top * (1 + _SLACK) + _SLACK]
            exact = np.round(np.sqrt(((y[c] - self.x[i]) ** 2).sum(axis=1)), 12)
            all_ = [np.concatenate([old[i], new]) for old, new in ((self.d, exact), (self.none, none[c]), (self.id, ident[c]), (self.key, key[c]), (self.of, node[c]))]
            o = np.lexsort((all_[3], all_[2], all_[1], all_[0]))[: self.k]
            self.d[i], self.none[i], self.id[i], self.key[i], self.of[i] = (a[o] for a in all_)
            self.tau[i] = min(self.tau[i], self.d[i, -1])

    @staticmethod
    def _spans(row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64), len(row))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(row[lo]), lo, hi

    def found(self) -> dict:
        i, j = np.nonzero(np.isfinite(self.d))
        return {"node": self.node[i], "tau": self.tau[i], "d": self.d[i, j], "none": self.none[i, j], "ni": self.id[i, j], "nk": self.key[i, j]}


_FOUND = "node long, tau double, d double, none boolean, ni long, nk long"


def _vectors(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _stream(k: int, levels: tuple[int, ...]):
    """Tasks come one after another: first a task's queries, then the rows they are to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, search = None, [], None

        def result() -> Iterator[pa.RecordBatch]:
            if search is not None:
                out = search.found()
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in ("node", "tau", "d", "none", "ni", "nk")], ["node", "tau", "d", "none", "ni", "nk"])

        for b in batches:
            t, rank = b.column("task").to_numpy(), b.column("rank").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | ((rank[1:] < 0) != (rank[:-1] < 0)))) if len(t) else np.empty(0, np.int64), len(t))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if t[lo] != task:
                    yield from result()
                    task, asked, search = t[lo], [], None
                part = b.slice(lo, hi - lo)
                if rank[lo] < 0:
                    asked.append(part)
                    continue
                if not asked:
                    continue
                dim = int(part.column("dim")[0].as_py())
                if search is None:
                    search = Search(np.concatenate([_vectors(a, "v", dim) for a in asked]), *(np.concatenate([a.column(c).to_numpy() for a in asked]) for c in ("node", "tau")), k, levels)
                ident = part.column("id")
                search.see(_vectors(part, "v", dim), part.column("node").to_numpy(), np.asarray(ident.is_null()), ident.fill_null(0).to_numpy(), part.column("key").to_numpy())
        yield from result()

    return run


class Boxes:
    """A tree of boxes: of each block, and of groups of neighbouring blocks."""

    def __init__(self, part: np.ndarray, dim: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.part, self.dim, self.lo, self.hi = part, dim, lo, hi
        self.first = np.arange(0, len(part), max(1, math.isqrt(len(part))))
        self.top = (np.minimum.reduceat(lo, self.first), np.maximum.reduceat(hi, self.first)) if len(part) else (lo, hi)

    def near(self, dim: int, lo: np.ndarray, hi: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, squared gaps), nearest first, of the blocks whose box is within the limit of the box given."""
        gap = lambda a, b: (np.maximum(np.maximum(lo - b, a - hi), 0) ** 2).sum(axis=1)
        groups = np.flatnonzero(gap(*self.top) <= limit)
        ends = np.append(self.first[1:], len(self.part))
        at = np.concatenate([np.empty(0, np.int64), *[np.arange(self.first[g], ends[g]) for g in groups]])
        at = at[self.dim[at] == dim]
        g = gap(self.lo[at], self.hi[at])
        ok = g <= limit
        at, g = at[ok], g[ok]
        o = np.lexsort((self.part[at], g))
        return at[o], g[o]


def _prepare(levels: tuple[int, ...]):
    """The coarsest statistics of each vector."""

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        dims = b.column("dim").to_numpy()
        v = b.column("v")
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            s = statistics(x, levels[0] if levels else 1)
            # vectors of fewer values than segments have as many columns
            s = np.pad(s, ((0, 0), (0, 2 * (levels[0] if levels else 1) - s.shape[1])))
            yield {**{c: b.column(c).take(pa.array(at)) for c in ("id", "key", "dim", "v")}, "s": list(s)}

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, levels: tuple[int, ...] = LEVELS, block: int = BLOCK, together: int = TOGETHER, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the ``k`` nearest other rows, among all rows, of every query: a row whose id is divisible by ``every`` (1: every row, also without an id).

    The distance is Euclidean; ranks from 1, ties by neighbour id (nulls last), then by a hash of the vector. Distances are rounded to 6 digits after ranking.
    Vectors that are null or empty or hold a null, NaN or infinity take no part; vectors of different lengths are not compared. Rows alike in id and vector are one;
    equal vectors of other ids are neighbours at 0. A query with fewer than k others has as many. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(q(id_col).cast("long").alias("id"), q(vector_col).cast("array<double>").alias("v"))
    v = v.where(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    v = v.dropDuplicates(["id", "v"]).withColumns({"key": F.xxhash64("v"), "dim": F.size("v")})
    v = durable(in_arrow(_prepare(levels), v, "id long, key long, dim int, v array<double>, s array<double>"))
    n = v.count()
    blocks = max(1, min(-(-n // block), MAX_BLOCKS))
    # blocks by the first two coarse means; numbers are given once, in the stored table
    coarse = [F.round(F.col("s")[i], 3) for i in (0, 2)] if levels and levels[0] > 1 else [F.col("s")[0]]
    placed = v.withColumn("c", coarse[0]).repartitionByRange(blocks, "dim", "c", "key", "id")
    placed = durable(placed.select("id", "key", "dim", "v", "s", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("node")))
    query = placed if every == 1 else placed.where(F.col("id") % every == 0)
    sides = placed.select("part", "dim", F.posexplode("s")).groupBy("part", "dim", "pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    sorted_ = F.sort_array(F.collect_list(F.struct("pos", "lo", "hi")))
    rows = sides.groupBy("part", "dim").agg(sorted_.alias("b")).orderBy("dim", "part").collect()  # one row a block, MAX_BLOCKS at most for each length of vectors
    width = 2 * (levels[0] if levels else 1)
    boxes = Boxes(np.array([r.part for r in rows]), np.array([r.dim for r in rows]), *(np.array([[getattr(x, side) for x in r.b] for r in rows]).reshape(len(rows), width) for side in ("lo", "hi")))
    shared = spark.sparkContext.broadcast(boxes)
    task = F.xxhash64("dim", "part")
    inf = F.lit(float("inf"))
    cols = ["task", "rank", "dim", "node", "id", "key", "v", "tau"]
    stream = lambda df: df.repartition("task").sortWithinPartitions("task", "rank", "node").mapInArrow(_stream(k, levels), _FOUND)
    # each query in its own block
    own = query.withColumns({"task": task, "rank": F.lit(-1), "tau": inf}).select(*cols)
    home = placed.join(query.select("part", "dim").distinct(), ["part", "dim"], "left_semi").withColumns({"task": task, "rank": F.lit(0), "tau": inf}).select(*cols)
    first = durable(stream(own.unionByName(home)))
    tau = first.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("t")).select("node", F.when(F.col("n") == k, F.col("t")).otherwise(inf).alias("tau"))
    # queries of neighbouring blocks go together
    per = max(1, together * blocks // max(1, n if every == 1 else -(-n // every)))
    asks = durable(query.join(tau, "node", "left").withColumns({"tau": F.coalesce("tau", inf), "qb": F.floor(F.col("part") / F.lit(per)).cast("int")}).select("qb", "dim", "node", "id", "key", "v", "s", "tau"))
    sides = asks.select("qb", "dim", "tau", F.posexplode("s")).groupBy("qb", "dim", "pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.max("tau").alias("tau"))
    groups = sides.groupBy("qb", "dim").agg(sorted_.alias("b"), F.max("tau").alias("tau"))

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g in f.itertuples():
                lo, hi = (np.array([x[side] for x in g.b]) for side in ("lo", "hi"))
                at, _ = shared.value.near(g.dim, lo, hi, float(_limit(np.array([g.tau]))[0]))
                stripes = max(1, -(-len(at) // STRIPE))
                # near and far blocks in every stripe
                out += [(g.qb, g.dim, int(shared.value.part[x]), r % stripes, r) for r, x in enumerate(at.tolist())]
            yield pd.DataFrame(out, columns=["qb", "dim", "part", "stripe", "rank"]).astype("int32")

    pairs = durable(groups.repartition("qb", "dim").mapInPandas(reach, "qb int, dim int, part int, stripe int, rank int"))
    task = F.xxhash64("qb", "dim", "stripe")
    left = asks.join(pairs.select("qb", "dim", "stripe").distinct(), ["qb", "dim"]).withColumns({"task": task, "rank": F.lit(-1)}).select(*cols)
    right = placed.join(pairs, ["part", "dim"]).withColumns({"task": task, "tau": inf}).select(*cols)
    found = stream(left.unionByName(right)).drop("tau")
    by = Window.partitionBy("node").orderBy("d", "none", "ni", "nk")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    ids = asks.select("node", F.col("id").alias("vec_id"))
    return best.join(ids, "node").select("vec_id", "rank", F.when(~F.col("none"), F.col("ni")).alias("neighbour_id"), F.round("d", 6).alias("distance"))
