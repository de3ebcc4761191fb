"""Event-time windows over streams. An extension: the batch operators work on each window's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import col, listed


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a directory as they come."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(directory)


def _timed(df: DataFrame, time: str) -> tuple[DataFrame, Column]:
    """Watermarks ask for timestamps with a zone."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        df = df.withColumn(time, col(time).cast("timestamp"))
    return df, col(time)


def windowed(df: DataFrame, time: str, size: str, aggregates: dict[str, str], *, slide: str | None = None, late: str = "0 seconds", categories: str | list[str] | None = None) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows; rows later than ``late`` behind the latest time are dropped. ``aggregates`` is {new name: SQL aggregate}."""
    df, at = _timed(df, time)
    d = df.withWatermark(time, late) if df.isStreaming else df
    out = d.groupBy(F.window(at, size, slide or size).alias("w"), *[col(c) for c in listed(categories)]).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[col(c) for c in listed(categories)], *[col(n) for n in aggregates])


def sessions(df: DataFrame, time: str, gap: str, aggregates: dict[str, str], *, late: str = "0 seconds", categories: str | list[str] | None = None) -> DataFrame:
    """Windows that end when nothing has come for ``gap``."""
    df, at = _timed(df, time)
    d = df.withWatermark(time, late) if df.isStreaming else df
    out = d.groupBy(F.session_window(at, gap).alias("w"), *[col(c) for c in listed(categories)]).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[col(c) for c in listed(categories)], *[col(n) for n in aggregates])


def deduplicated(df: DataFrame, keys: str | list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; state is kept for ``late`` only."""
    df, _ = _timed(df, time)
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(listed(keys)) if df.isStreaming else df.dropDuplicates(listed(keys))
