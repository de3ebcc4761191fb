"""Writers. A single file is asked for by its name: executors write parts in parallel, and the parts are joined in order by streaming copies; a directory (a path without a known ending) keeps the parts."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import sqlite3
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import col
from sparkloom.operators.order import in_order, visible
from sparkloom.sources.files import extension


def _iso(df: DataFrame) -> DataFrame:
    """Dates and times as ISO texts in UTC."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = F.date_format(col(f.name).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.withColumns(out) if out else df


def _parts(directory: str) -> list[str]:
    return sorted(os.path.join(directory, f) for f in os.listdir(directory) if f.startswith("part-"))


def _join_parquet(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file of the row groups of all parts, in order; they are copied as they are, and only the footers are read."""
    jvm = spark.sparkContext._jvm
    parquet = jvm.org.apache.parquet
    local = lambda p: jvm.java.io.File(os.path.abspath(p)).toPath()
    reader = parquet.hadoop.ParquetFileReader.open(parquet.io.LocalInputFile(local(parts[0])))
    meta = reader.getFileMetaData()
    reader.close()
    mode = getattr(parquet.hadoop, "ParquetFileWriter$Mode").OVERWRITE
    writer = parquet.hadoop.ParquetFileWriter(parquet.io.LocalOutputFile(local(path)), meta.getSchema(), mode, 128 << 20, 0)
    writer.start()
    for part in parts:
        writer.appendFile(parquet.io.LocalInputFile(local(part)))
    writer.end(meta.getKeyValueMetaData())


def write_data(df: DataFrame, path: str, *, compression: bool = False, as_arrays: bool = False, format_dates: bool = False) -> str:
    """CSV, JSON (an array of objects, or an object of arrays), Parquet or SQLite by the file's ending. Returns the path, with .gz where text is compressed.

    The path must be on a file system that driver and executors share; ``write_partitioned`` takes any path that Spark knows.
    """
    kind = extension(path)
    if any(isinstance(f.dataType, T.BinaryType) for f in df.schema) and kind != ".parquet":
        raise ValueError("geometries are written by write_geo_data")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    names = visible(df)
    d = in_order(df).select(*[col(c) for c in names])
    d = _iso(d) if format_dates and kind in (".csv", ".json") else d
    if kind in (".db", ".sqlite"):
        return write_sqlite({os.path.splitext(os.path.basename(path))[0]: d}, path)
    if kind == ".parquet":
        with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(path))) as tmp:
            d.write.option("compression", "zstd" if compression else "snappy").parquet(f"{tmp}/out")
            _join_parquet(df.sparkSession, _parts(f"{tmp}/out"), f"{tmp}/whole")
            shutil.move(f"{tmp}/whole", path)
        return path
    if compression and not path.endswith(".gz"):
        path += ".gz"
    opener: Any = gzip.open if path.endswith(".gz") else open
    if kind == ".json" and as_arrays:
        arrays = {c: [] for c in names}
        for row in d.toLocalIterator():
            for c in names:
                arrays[c].append(_plain(row[c]))
        with opener(path, "wt", encoding="utf-8") as f:
            json.dump(arrays, f, ensure_ascii=False)
        return path
    with tempfile.TemporaryDirectory(dir=os.path.dirname(os.path.abspath(path))) as tmp:
        if kind == ".csv":
            d.write.option("header", False).option("escape", '"').option("emptyValue", "").csv(f"{tmp}/out")
        elif kind == ".json":
            d.write.option("ignoreNullFields", False).json(f"{tmp}/out")
        else:
            raise ValueError(f"{kind or path!r} can't be written")
        with opener(path, "wt", encoding="utf-8", newline="") as f:
            first = True
            if kind == ".csv":
                f.write(",".join(f'"{c}"' if any(x in c for x in ',"\n') else c for c in names) + "\n")
            else:
                f.write("[\n")
            for part in _parts(f"{tmp}/out"):
                with open(part, encoding="utf-8", newline="") as p:
                    if kind == ".csv":
                        shutil.copyfileobj(p, f)
                        continue
                    for line in p:
                        f.write(("" if first else ",\n") + line.rstrip("\n"))
                        first = False
            if kind == ".json":
                f.write("\n]\n")
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet", mode: str = "error") -> None:
    """A directory of files written by all executors: the way for large tables."""
    w = df.select(*[col(c) for c in visible(df)]).write.mode(mode).format(fmt)
    (w.partitionBy(*by) if by else w).save(path)


def _plain(v: Any) -> Any:
    if v is None or isinstance(v, (str, int, float, bool)):
        return v
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def write_sqlite(tables: dict[str, DataFrame], path: str) -> str:
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER"}
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            d = in_order(df).select(*[col(c) for c in visible(df)])
            q = lambda x: '"' + x.replace('"', '""') + '"'
            db.execute(f"DROP TABLE IF EXISTS {q(name)}")
            db.execute(f"CREATE TABLE {q(name)} ({', '.join(f'{q(f.name)} {kinds.get(f.dataType.simpleString(), "TEXT")}' for f in d.schema)})")
            db.executemany(f"INSERT INTO {q(name)} VALUES ({', '.join('?' for _ in d.columns)})", (tuple(_plain(v) for v in r) for r in d.toLocalIterator()))
    return path
