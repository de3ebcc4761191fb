"""A corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet, and the next stage reads that. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm._common import durable
from sparkloom.llm.decontaminate import remove_contamination
from sparkloom.llm.language_id import fit, keep_identified
from sparkloom.llm.mixing import with_rates
from sparkloom.llm.near_dedup import drop_near_duplicates
from sparkloom.llm.secret_scan import redact_secrets, scan_new
from sparkloom.storage import new_path, remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no words, in which no language has half of the words, or whose words are of none of the languages; ``lang`` becomes the identified language."""
    return keep_identified(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; each distinct text is scanned into the ledger once."""
    return redact_secrets(docs, durable(scan_new(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds tokens, rate and copies: how often each document is to be used for the target weights."""
    return with_rates(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]

#: A trained field and Newton's method are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one is written, the last table at the end of the process.

    Null and empty texts and texts without words go in the first stage; texts of any length go through whole; of rows alike in id and text one stays (second stage); ids may be null.
    An empty table of documents, or of benchmark items, gives an empty result, or nothing to cut. Columns beyond those of ``documents`` are kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
