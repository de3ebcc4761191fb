"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, on one machine only: on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loom-"))
    return _own[0]


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder; what is written there goes with ``clear`` or at the end of the process."""
    path = f"{shared_folder(spark)}/loom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and read from a table in the shared folder: whatever reads them twice sees the same rows, also after the loss of an executor."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema):
        df = df.select(*[df[f"`{f.name}`"].cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else df[f"`{f.name}`"] for f in df.schema])
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table that ``stored`` wrote for this DataFrame, which nothing reads any more."""
    path = getattr(df, "loom_path", None)
    for entry in [x for x in _written if x[1] == path]:
        remove(*entry)
        _written.remove(entry)


def clear(spark: SparkSession | None = None) -> None:
    """Removes what was stored, of one session or of all."""
    for s, path in list(_written):
        if spark is None or s is spark:
            try:
                remove(s, path)
            except Exception:  # noqa: BLE001  Spark may have been stopped; what lies in a local folder can still go
                local = path.removeprefix("file://").removeprefix("file:")
                for p in (local, os.path.join(os.path.dirname(local), f".{os.path.basename(local)}.crc")):
                    shutil.rmtree(p, ignore_errors=True) if os.path.isdir(p) else os.path.exists(p) and os.remove(p)
            _written.remove((s, path))


atexit.register(clear)
