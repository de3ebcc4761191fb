"""Joins and cleaning by similarity of texts.

Candidates come from an equi-join on blocking keys, never from a nested loop where there is a lossless key: for ratio and token_sort_ratio, two texts of score t
have lengths that differ by at most (200 - 2t) / (200 - t) of the longer one; lengths are banded accordingly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.exprs import col
from sparkloom.functions.similarity import METHODS
from sparkloom.operators.columns import need
from sparkloom.operators.order import ORD, ordered
from sparkloom.storage import forget, stored


def score(a: Column, b: Column, method: str) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    f = METHODS[method]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _bands(length: Column, share: float) -> tuple[Column, Column]:
    """Geometric bands of lengths so wide that texts within reach are in the same or neighbouring bands."""
    width = math.log(1 / max(1e-9, 1 - share)) if share < 1 else 50.0
    band = F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(max(width, 1e-6)))
    return band, F.array(band - 1, band, band + 1)


def candidates(left: DataFrame, right: DataFrame, threshold: float, method: str, prefix: int | None) -> DataFrame:
    """Pairs (a, b) of the texts of ``left`` (a) and ``right`` (b) that can reach the threshold."""
    keys = []
    if prefix:
        left, right = left.withColumn("__p", F.left("a", F.lit(prefix))), right.withColumn("__p", F.left("b", F.lit(prefix)))
        keys.append("__p")
    if threshold >= 100 and method == "ratio":
        return left.withColumn("__e", F.col("a")).join(right.withColumn("__e", F.col("b")), [*keys, "__e"]).select("a", "b")
    if method in ("ratio", "token_sort_ratio") and threshold > 0:
        # white space is single and outer blanks are gone in what token_sort_ratio compares
        size = (lambda c: F.length(F.trim(F.regexp_replace(c, r"\s+", " ")))) if method == "token_sort_ratio" else F.length
        share = (200 - 2 * threshold) / (200 - threshold)
        la, lb = size(F.col("a")), size(F.col("b"))
        own, _ = _bands(la, share)
        _, near = _bands(lb, share)
        left, right = left.withColumn("__b", own), right.withColumn("__b", F.explode(near))
        return left.join(right, [*keys, "__b"]).where(F.abs(la - lb) <= F.lit(share) * F.greatest(la, lb) + 1e-9).select("a", "b")
    return (left.join(right, keys) if keys else left.crossJoin(right)).select("a", "b")


def fuzzy_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, threshold: float, method: str = "ratio", similarity_column: str | None = None, prefix: int | None = None) -> DataFrame:
    """Left rows with all right rows whose texts score at least ``threshold`` (scores rounded to 2 digits); left rows without one get nulls. Each distinct pair of texts is scored once."""
    need(left, [left_column])
    need(right, [right_column])
    shared = [c for c in left.columns if c in right.columns and c != ORD]
    if shared:
        raise ValueError(f"both tables have {shared}; rename them first")
    a = left.select(col(left_column).alias("a")).where("a is not null").distinct()
    b = right.select(col(right_column).alias("b")).where("b is not null").distinct()
    name = similarity_column or "__similarity"
    scored = candidates(a, b, threshold, method, prefix).withColumn(name, F.round(score(F.col("a"), F.col("b"), method), 2)).where(col(name) >= threshold)
    matched = scored.join(right.drop(ORD), scored["b"] == col(right_column))
    out = left.join(matched, col(left_column) == F.col("a"), "left").drop("a", "b")
    out = out.orderBy(col(left_column).asc_nulls_last(), col(name).desc_nulls_last(), col(right_column).asc_nulls_last())
    return out if similarity_column else out.drop("__similarity")


def fuzzy_clean(df: DataFrame, column: str, new: str, threshold: float, method: str = "ratio", keep: str = "mostCommon", prefix: int | None = None) -> DataFrame:
    """Similar values become one value of their cluster: the most common, longest, shortest or most central one (of the greatest sum of scores), or the one of the greatest single score; ties by score sum, then in alphabetical order."""
    if keep not in ("mostCommon", "longestString", "shortestString", "mostCentral", "maxScore"):
        raise ValueError(f"unknown rule {keep!r}")
    need(df, [column])
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = candidates(counts.select(F.col("v").alias("a")), counts.select(F.col("v").alias("b")), threshold, method, prefix).where("a < b").distinct()
    scored = pairs.withColumn("s", score(F.col("a"), F.col("b"), method)).where(F.col("s") >= threshold)
    scored = stored(scored)
    roots = _clusters(scored)
    sums = scored.select(F.col("a").alias("v"), "s").unionByName(scored.select(F.col("b").alias("v"), "s")).groupBy("v").agg(F.sum("s").alias("total"), F.max("s").alias("top"))
    members = roots.join(counts, "v").join(sums, "v", "left").fillna(0.0, ["total", "top"])
    first = {"mostCommon": F.desc("n"), "longestString": F.desc(F.length("v")), "shortestString": F.asc(F.length("v")), "mostCentral": F.desc("total"), "maxScore": F.desc("top")}[keep]
    w = Window.partitionBy("root").orderBy(first, F.desc("total"), F.asc("v"))
    mapping = members.withColumn("__to", F.first("v").over(w)).select(F.col("v").alias("__v"), "__to").where("__v <> __to")
    out = ordered(df).join(mapping, col(column) == F.col("__v"), "left")
    return out.withColumn(new, F.coalesce("__to", col(column))).drop("__v", "__to")


#: Up to so many pairs are put together on the driver; more of them on the executors, with the same result.
DRIVER_PAIRS = 100_000


def _clusters(edges: DataFrame) -> DataFrame:
    """(v, root) of connected values: a union-find if pairs are few, else least-label propagation with pointer jumping, so long chains take few rounds."""
    few = edges.select("a", "b").limit(DRIVER_PAIRS + 1).collect()
    if len(few) <= DRIVER_PAIRS:
        up: dict[str, str] = {}

        def root(v: str) -> str:
            while up.setdefault(v, v) != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for e in few:
            x, y = root(e.a), root(e.b)
            up[max(x, y)] = min(x, y)
        return edges.sparkSession.createDataFrame([(v, root(v)) for v in list(up)], "v string, root string")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("v"), "root")
    label = stored(label)
    while True:
        near = both.join(label, "v").groupBy("u").agg(F.min("root").alias("m"))
        step = label.join(near, label["v"] == near["u"], "left").select("v", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = step.alias("x").join(step.alias("y"), F.col("x.root") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.least(F.col("x.root"), F.coalesce(F.col("y.root"), F.col("x.root"))).alias("root"))
        jump = stored(jump)
        changed = jump.join(label.withColumnRenamed("root", "old"), "v").where("root <> old").limit(1).count()
        forget(label)
        label = jump
        if not changed:
            return label
