"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010).

Each document's word shingles give ``BANDS * WIDTH`` minima. Bands of full minima make candidates; the low ``BITS`` bits of all minima, packed into
64-bit words, give the similarity of two candidates by a bit count, corrected for chance collisions. Similar pairs are joined into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._buckets import BLOCK, links
from sparkloom.llm._common import WORD_BYTE, durable, fresh, hash_words, in_arrow, q, row_key, sifted, split_words, text_chunks
from sparkloom.llm._graph import components
from sparkloom.llm._minhash import Hasher, band_hashes, pack, shingles, similarity

#: Words of a shingle.
SHINGLE = 3
#: Least estimated Jaccard similarity of near duplicates.
THRESHOLD = 0.5
#: 32 bands of 4 minima find a pair of similarity 0.6 with probability 0.99, of 0.5 with 0.87.
BANDS, WIDTH = 32, 4
#: Bits kept of each minimum.
BITS = 4


def _signatures(shingle: int, bands: int, width: int, bits: int):
    hasher = Hasher(bands * width)

    def run(b: pa.RecordBatch) -> Iterator[dict]:
        key, doc_id = b.column("key"), b.column("doc_id")
        for lo, _, buf, offs in text_chunks(b.column("text"), lower=True):
            st, en, first, m = split_words(buf, offs, WORD_BYTE)
            rows, minima = hasher.minima(*shingles(hash_words(buf, st, en, m), first, shingle))
            if len(rows):
                sig = pack(minima, bits)
                raw, step = sig.tobytes(), sig.shape[1] * 8
                band = band_hashes(minima, bands, width)
                yield {
                    "key": key.take(pa.array(lo + rows)),
                    "doc_id": doc_id.take(pa.array(lo + rows)),
                    "sig": [raw[i * step : i * step + step] for i in range(len(rows))],
                    "bands": pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * bands, pa.array(band.ravel())),
                }

    return run


def _close(threshold: float, bits: int):
    def of(payloads: list[bytes]):
        sig = np.frombuffer(b"".join(payloads), np.uint64).reshape(len(payloads), -1)
        return lambda i, rows: similarity(sig[i], sig[rows], bits) >= threshold

    return of


def _groups(d: DataFrame, threshold: float, shingle: int, bands: int, width: int, bits: int, block: int) -> DataFrame:
    """(root, doc_id, key) of the documents (doc_id, key, text) of groups of near duplicates; those alike in doc_id and key once.

    The nodes are numbers of the stored signatures, so no two documents share one.
    """
    sigs = in_arrow(_signatures(shingle, bands, width, bits), d, "doc_id long, key long, sig binary, bands array<long>")
    sigs = durable(sigs.withColumn("node", F.monotonically_increasing_id()))
    # documents of one signature are near duplicates already: one of them goes on for all, so copies by the million weigh as one
    reps = sigs.groupBy("sig").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n"))
    alike = sigs.select("sig", "node").join(reps.where("n > 1").select("sig", "rep"), "sig").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    own = sigs.join(reps.select(F.col("rep").alias("node")), "node", "left_semi")
    band = own.select(F.explode("bands").alias("band"), "node")
    shared = band.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("band")
    # only rows that share a bucket carry their signature
    met = durable(band.join(shared, "band").distinct())
    payloads = sigs.select("node", F.col("sig").alias("payload"))
    edges = links(met, payloads, _close(threshold, bits), "long", block)
    groups = components(edges.unionByName(alike))
    return groups.join(sigs.select("node", "doc_id", "key"), "node").select("root", "doc_id", "key").distinct()


def _firsts(members: DataFrame) -> DataFrame:
    """(root, first) of the groups of more than one document: the member that stays, of the least doc_id (nulls last), then of the least key."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    return members.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id, kept) for each document that has a near duplicate; group_id is the doc_id kept of the group, the least one (nulls last).

    Words are runs of letters, digits and underscores without regard to case. A text of fewer words than a shingle is one shingle. Null texts and texts
    without words are nobody's duplicates and never appear. Rows alike in doc_id and text are one document; a doc_id
    with several texts is several documents. Groups are connected components: all pairs that share a band are compared, none is skipped.
    Texts are read whole, however long; a text must fit in a task's memory. An empty table gives an empty result; other columns are not read.
    """
    d = docs.select(row_key(id_col, text_col).alias("key"), q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text")).where("text is not null")
    members = durable(_groups(d, threshold, shingle, bands, width, bits, block))
    kept = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return members.join(_firsts(members), "root").select("doc_id", F.col("first.doc_id").alias("group_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents with one of each near-duplicate group, that of the least id (nulls last), and with one of rows alike in id and text; all columns stay as they are.

    Of rows alike in id and text the one stays whose columns together have the least hash, so a repeated run keeps the same rows. Null texts and texts without words
    are nobody's near duplicates. Texts are read whole, however long. An empty table stays empty. Texts that stay do not move, but for about one in 200 and those of rows alike.
    """
    k, i, verdict = fresh(docs, "loom_key"), fresh(docs, "loom_id"), fresh(docs, "loom_verdict")
    keyed = docs.withColumn(k, row_key(id_col, text_col)).withColumn(i, q(id_col).cast("long"))
    d = keyed.select(q(k).alias("key"), q(i).alias("doc_id"), q(text_col).alias("text")).where("text is not null")
    members = durable(_groups(d, threshold, shingle, bands, width, bits, block))
    gone = members.join(_firsts(members), "root").where(~((F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))))
    again = keyed.groupBy(q(i).alias("doc_id"), q(k).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key")
    again = durable(again)
    some = not again.isEmpty()
    found = gone.select("doc_id", "key", F.lit("gone").alias("v"))
    if some:
        found = found.unionByName(again.join(gone.select("doc_id", "key"), (again["key"] == gone["key"]) & again["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select("doc_id", "key", F.lit("again").alias("v")))
    found = durable(found.select(F.col("doc_id").alias("loom__i"), F.col("key").alias("loom__k"), F.col("v").alias(verdict)))
    rest, maybe = sifted(keyed, q(k), found.select("loom__k"))
    marked = maybe.join(found, (q(k) == F.col("loom__k")) & q(i).eqNullSafe(F.col("loom__i")), "left").drop("loom__i", "loom__k")
    row = [q(c) for c in docs.columns]
    once = rest.select(*row).union(marked.where(q(verdict).isNull()).select(*row))
    if not some:
        return once
    picked = marked.where(q(verdict) == "again").groupBy(q(i), q(k)).agg(F.min_by(F.struct(*row), F.xxhash64(*row, *[c.isNull() for c in row])).alias("r"))
    return once.unionByName(picked.select(*[F.col("r")[c].alias(c) for c in docs.columns]))
