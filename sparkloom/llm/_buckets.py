"""Links between the rows that share a band: every pair of a bucket that could join two groups is compared, and no task holds a whole large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, grouped, lean
from sparkloom.llm._minhash import bucket_edges
from sparkloom.storage import forget

#: Rows of a bucket that one task compares as a whole; larger buckets are split.
BLOCK = 4096

#: Of the payloads of some rows, the function close(i, rows): which of ``rows`` are close to row i.
Close = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def _edges(nodes: pa.Array, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([np.empty(0, np.int64), *[p[0] for p in pairs]]).astype(np.int64)
    v = np.concatenate([np.empty(0, np.int64), *[p[1] for p in pairs]]).astype(np.int64)
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(u)), nodes.take(pa.array(v))], ["u", "v"])


def _whole(close: Close):
    """Buckets that come whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "band", 1 << 13):
            band = t.column("band").to_numpy()
            near = close(t.column("payload").to_pylist())
            start = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            ends = np.append(start[1:], t.num_rows)
            first = np.concatenate([np.append(True, near(lo, np.arange(lo + 1, hi))) for lo, hi in zip(start.tolist(), ends.tolist(), strict=True)])
            yield _edges(t.column("node").combine_chunks(), list(bucket_edges(start, t.num_rows, near, first.astype(bool))))

    return run


def _pivot(close: Close):
    """Whether each row is close to its bucket's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, pivots = b.column("payload").to_pylist(), b.column("pivot_payload").to_pylist()
            at = {p: i for i, p in enumerate(dict.fromkeys(pivots))}
            near = close([*at, *own])
            of = np.array([at[p] for p in pivots], np.int64)
            out = np.zeros(b.num_rows, bool)
            for i in range(len(at)):
                rows = np.flatnonzero(of == i)
                out[rows] = near(i, rows + len(at))
            keep = [b.schema.get_field_index(c) for c in ("band", "node", "payload", "pivot")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out)], ["band", "node", "payload", "pivot", "near"])

    return run


def _cross(close: Close):
    """Rows of a part of a bucket that are not close to its pivot (``far``) against rows of another part. Those close to the pivot are one group already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "task", 1 << 13):
            cols = [t.column(c).to_numpy() for c in ("task", "band", "i", "j")]
            far, near_pivot = t.column("far").to_numpy(zero_copy_only=False), t.column("near").to_numpy(zero_copy_only=False)
            cut = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
            start = np.flatnonzero(cut)
            close_to = close(t.column("payload").to_pylist())
            pairs = []
            for lo, hi in zip(start.tolist(), np.append(start[1:], t.num_rows).tolist(), strict=True):
                rows = np.arange(lo, hi)
                asks, others = rows[far[lo:hi]], rows[~far[lo:hi]]
                root = {int(r): int(r) for r in rows}
                pivot_group = others[near_pivot[others]]
                for r in pivot_group.tolist():
                    root[r] = int(pivot_group[0])

                def find(x: int, root: dict = root) -> int:
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                u, v = [], []
                for r in asks.tolist() if len(others) else []:
                    for m in others[close_to(r, others)].tolist():
                        a, b = find(r), find(m)
                        if a != b:
                            root[a] = b
                            u.append(r)
                            v.append(m)
                if u:
                    pairs.append((np.array(u), np.array(v)))
            yield _edges(t.column("node").combine_chunks(), pairs)

    return run


def links(met: DataFrame, payloads: DataFrame, close: Close, node: str, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect the rows of each bucket that are close, directly or by others.

    ``met``: (band, node), each pair once, read from a table; ``payloads``: (node, payload), what ``close`` compares; ``node``: the node's SQL type.
    A bucket of up to ``block`` rows is compared by one task. Of a larger one, all rows are compared with one of them, the pivot, wherever they lie;
    rows that are not close to it are then compared with all rows of the bucket, part by part of up to about ``block`` rows.
    """
    edge = f"u {node}, v {node}"
    sizes = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where(F.col("n") > block)
    hot = durable(sizes)
    any_hot = not hot.isEmpty()
    plain = met.join(hot.select("band"), "band", "left_anti") if any_hot else met
    meet = plain.join(payloads, "node").select("band", "node", "payload").repartition("band").sortWithinPartitions("band", "node")
    out = meet.mapInArrow(lean(_whole(close)), edge)
    if not any_hot:
        forget(hot)
        return out.where("u <> v")
    pivots = hot.join(payloads.withColumnRenamed("node", "pivot"), "pivot").select("band", "pivot", F.col("payload").alias("pivot_payload"))
    members = met.join(payloads, "node").join(pivots, "band").select("band", "node", "payload", "pivot", "pivot_payload")
    judged = durable(members.mapInArrow(lean(_pivot(close)), f"band long, node {node}, payload binary, pivot {node}, near boolean"))
    out = out.unionByName(judged.where("near").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    rest = judged.where("not near").groupBy("band").agg(F.count(F.lit(1)).alias("far_n"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(float(block))).cast("int")
    sized = judged.join(hot.select("band", "n").join(rest, "band"), "band").withColumns({"pn": parts("n"), "pf": parts("far_n"), "h": F.xxhash64("node", F.lit("part"))})
    asks = sized.where("not near").select("band", F.pmod("h", "pf").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("j"), "node", "payload", "near", F.lit(True).alias("far"))
    others = sized.select("band", F.explode(F.sequence(F.lit(0), F.col("pf") - 1)).alias("i"), F.pmod("h", "pn").cast("int").alias("j"), "node", "payload", "near", F.lit(False).alias("far"))
    both = asks.unionByName(others).withColumn("task", F.xxhash64("band", "i", "j"))
    crossed = both.repartition("task").sortWithinPartitions("task", "band", "i", "j", "far", "node").mapInArrow(lean(_cross(close)), edge)
    return out.unionByName(crossed).where("u <> v")
