"""Mixing sources to target weights by entropy balancing (Hainmueller, 2012).

Among all document rates that give each level of each margin its share of the tokens, those closest in relative entropy to equal rates are exponential in the constraints:
rate = exp(lambda . x). The convex dual is minimised by Newton's method; its gradient and Hessian are sums over the corpus, formed by executors
and added up in a shuffle. Rates are then rounded into copies without bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._common import durable, fresh, in_arrow, q, row_key

#: Shares of the tokens: a number is a temperature (share proportional to tokens ** number), a dict gives the levels' shares outright.
TARGETS: dict[str, float | dict] = {"source": 0.5, "lang": 0.75}
#: Up to so many levels of all margins together, a Newton step is solved as one dense system; beyond, by conjugate gradients on the pairs of levels that occur. The solution is the same.
DENSE = 500
ITERATIONS, TOLERANCE = 50, 1e-10


def tokens(text_col: str) -> Column:
    """Tokens of a text: runs of characters that are not white space."""
    return F.coalesce(F.regexp_count(q(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def shares(cells: DataFrame, targets: dict[str, float | dict], weight: str) -> list[tuple[str, list, np.ndarray]]:
    """(column, levels, shares) of each margin. Levels that have no tokens get nothing; the rest are scaled to sum to 1. The driver holds the levels, some 100 bytes each."""
    out = []
    for name, goal in targets.items():
        rows = cells.groupBy(q(name)).agg(F.sum(q(weight)).alias(weight)).where(q(weight) > 0).collect()
        rows = sorted(((r[0], float(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0]))
        if isinstance(goal, dict):
            rows = [(level, float(goal[level])) for level, _ in rows if goal.get(level, 0) > 0]
        else:
            rows = [(level, t**goal) for level, t in rows]
        s = np.array([x for _, x in rows])
        out.append((name, [level for level, _ in rows], s / s.sum() if len(s) else s))
    return out


def _with_values(df: DataFrame, name: str, levels: list, values: list, kind: str, new: str) -> DataFrame:
    """A column with the value of the row's level in ``name``, null if it is none of ``levels``: a join with the table of levels. That is stored, so that its size is known: if it is small, Spark sends it to the tasks and the rows stay where they are."""
    level = fresh(df, "loom_level")
    schema = T.StructType([T.StructField(level, df.schema[name].dataType), T.StructField(new, T.DoubleType() if kind == "double" else T.IntegerType())])
    table = durable(df.sparkSession.createDataFrame(list(zip(levels, values, strict=True)), schema).coalesce(1))
    return df.join(table, q(name).eqNullSafe(q(level)), "left").drop(level)


class Moments:
    """Sum of t * exp(lambda . x) over the cells, its first moments, and its second moments as the pairs of levels (r, s) that occur and their sums."""

    def __init__(self, cells: DataFrame, codes: list[str], offsets: list[int], lam: np.ndarray):
        n = len(lam)
        shared = cells.sparkSession.sparkContext.broadcast(lam)

        def run(b: pa.RecordBatch) -> Iterator[dict]:
            lam = shared.value
            x = np.stack([b.column(c).to_numpy() + o for c, o in zip(codes, offsets, strict=True)])
            w = b.column("t").to_numpy() * np.exp(lam[x].sum(axis=0))
            at, inv = np.unique(np.concatenate([np.zeros(len(w), np.int64), *[1 + r for r in x], *[1 + n + r * n + s for r in x for s in x]]), return_inverse=True)
            yield {"at": at, "s": np.bincount(inv, weights=np.tile(w, 1 + len(x) + len(x) ** 2))}

        rows = in_arrow(run, cells.select("t", *codes), "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
        shared.unpersist()
        at, s = rows["at"].to_numpy(np.int64), rows["s"].to_numpy(float)
        self.z = float(s[at == 0].sum())
        self.first = np.zeros(n)
        one = (at > 0) & (at <= n)
        self.first[at[one] - 1] = s[one]
        two = at > n
        self.r, self.s = np.divmod(at[two] - 1 - n, n)
        self.second = s[two]

    def newton(self, grad: np.ndarray) -> np.ndarray:
        """The step -H^-1 grad with H = E[x x'] - E[x] E[x]'. The margins' indicators sum to one each, so H is singular: the shortest step is taken."""
        n, mean, pairs = len(self.first), self.first / self.z, self.second / self.z
        if n <= DENSE:
            h = np.zeros((n, n))
            h[self.r, self.s] = pairs
            return np.linalg.lstsq(h - np.outer(mean, mean), -grad, rcond=1e-12)[0]
        times = lambda v: np.bincount(self.r, weights=pairs * v[self.s], minlength=n) - mean * (mean @ v)
        scale = 1 / np.maximum(mean * (1 - mean), 1e-300)
        x, r = np.zeros(n), -grad
        z = scale * r
        p, rz, goal = z.copy(), r @ z, 1e-12 * np.linalg.norm(grad)
        for _ in range(min(10 * n, 5000)):
            hp = times(p)
            curve = p @ hp
            if curve <= 0:
                break
            x = x + (rz / curve) * p
            r = r - (rz / curve) * hp
            if np.linalg.norm(r) <= goal:
                break
            z = scale * r
            rz, old = r @ z, rz
            p = z + (rz / old) * p
        return x


def solve(cells: DataFrame, codes: list[str], margins: list[tuple[str, list, np.ndarray]], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(lambda, log of the mean of exp(lambda . x) over tokens). Damped Newton steps on the dual log-sum-exp(lambda) - lambda . target."""
    sizes = [len(levels) for _, levels, _ in margins]
    offsets = [int(sum(sizes[:i])) for i in range(len(sizes))]
    target = np.concatenate([s for _, _, s in margins])
    lam = np.zeros(len(target))
    now = Moments(cells, codes, offsets, lam)
    base = now.z
    for _ in range(iterations):
        grad = now.first / now.z - target
        if np.abs(grad).max() < tolerance:
            break
        step = now.newton(grad)
        dual, size = np.log(now.z) - lam @ target, 1.0
        while True:
            trial = lam + size * step
            then = Moments(cells, codes, offsets, trial)
            if np.log(then.z) - trial @ target <= dual + 1e-4 * size * (grad @ step) or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:
            break
        lam, now = trial, then
    return lam, float(np.log(now.z / base))


def with_rates(docs: DataFrame, targets: dict[str, float | dict] = TARGETS, total_tokens: float | None = None, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("tokens", "rate", "copies")) -> DataFrame:
    """The documents with the columns tokens, rate and copies.

    Expected tokens (tokens * rate) meet the target shares of every margin in ``targets``, as far as the targets can be met together. The scale is such that they sum to
    ``total_tokens``; without it, such that the lowest rate is 1, so every document of a wanted level stays. copies is rate rounded up or down by a uniform
    hash of id and text, so its mean is the rate.

    A null level is a level of its own. Levels that a dict of shares does not name have rate 0 and no copies. Null and empty texts have 0 tokens; they get the
    rate of their levels if some other document has these levels, otherwise 0. Repeated rows count and are mixed as many times; texts are counted whole, however long. An empty table gives an empty result.
    A new column whose name the documents have already gets an underscore behind its name.
    """
    t, rate, copies = (fresh(docs, x) for x in names)
    counted = docs.withColumn(t, tokens(text_col))
    w = fresh(counted, "loom_t")
    cells = durable(counted.groupBy(*[q(c) for c in targets]).agg(F.sum(q(t)).cast("double").alias(w)).where(q(w) > 0))
    margins = shares(cells, targets, w)
    codes = [fresh(cells, f"loom_x{i}") for i in range(len(margins))]
    coded = cells
    for c, (name, levels, _) in zip(codes, margins, strict=True):
        coded = _with_values(coded, name, levels, list(range(len(levels))), "int", c)
    coded = durable(coded.select(q(w).alias("t"), *codes).dropna())
    if coded.isEmpty():
        return counted.withColumns({rate: F.lit(0.0), copies: F.lit(0).cast("long")})
    lam, log_mean = solve(coded, codes, margins)
    powers = [fresh(counted, f"loom_power{i}") for i in range(len(margins))]

    def powered(df: DataFrame) -> DataFrame:
        at = 0
        for p, (name, levels, _) in zip(powers, margins, strict=True):
            df = _with_values(df, name, levels, [float(x) for x in lam[at : at + len(levels)]], "double", p)
            at += len(levels)
        return df

    power = sum((F.col(p) for p in powers[1:]), F.col(powers[0]))
    if total_tokens is None:
        shift = -powered(cells).agg(F.min(power)).first()[0]
    else:
        shift = float(np.log(total_tokens / coded.agg(F.sum("t")).first()[0])) - log_mean
    uniform = F.pmod(F.xxhash64(row_key(id_col, text_col), F.lit("copies")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rated = powered(counted).withColumn(rate, F.round(F.coalesce(F.exp(power + F.lit(float(shift))), F.lit(0.0)), 9)).drop(*powers)
    return rated.withColumn(copies, F.floor(q(rate) + uniform).cast("long"))
