"""Readers: CSV and other delimited text, JSON, Parquet, Excel, SQLite, GeoJSON, shapefiles, rows in memory."""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import glob
import io
import json
import os
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import col, listed
from sparkloom.functions.types import spark_type
from sparkloom.operators.order import ORD, ordered

_KINDS = {".csv": "csv", ".tsv": "dsv", ".txt": "dsv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".xlsx": "excel", ".geojson": "geojson", ".shp": "shp"}


def extension(path: str) -> str:
    """In lower case, without a compression's ending."""
    p = re.sub(r"\.(gz|zst|zstd|bz2)$", "", path.lower())
    return os.path.splitext(p)[1]


def kind_of(path: str, file_type: str | None = None, delim: str | None = None) -> str:
    if file_type:
        return file_type
    if delim:
        return "dsv"
    kind = _KINDS.get(extension(path))
    if kind is None:
        raise ValueError(f"the type of {path} is not known; name it")
    return kind


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that gives most columns, the same number in every line."""
    best, most = ",", 1
    for d in (",", "\t", ";", "|"):
        counts = {len(next(csv.reader([x], delimiter=d), [])) for x in lines if x.strip()}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def _head(path: str, n: int = 20, encoding: str = "utf-8") -> list[str]:
    first = sorted(glob.glob(path))[0] if glob.glob(path) else path
    if first.endswith((".gz",)):
        import gzip

        with gzip.open(first, "rt", encoding=encoding, errors="replace") as f:
            return [x.rstrip("\r\n") for _, x in zip(range(n), f, strict=False)]
    try:
        with open(first, encoding=encoding, errors="replace") as f:
            return [x.rstrip("\r\n") for _, x in zip(range(n), f, strict=False)]
    except OSError:
        return []


_NATIVE = {"gzip": ".gz", "bz2": ".bz2"}


def _unpacked(spark: SparkSession, files: list[str], compression: str) -> DataFrame:
    """(value, filename): the lines of files that are compressed without saying so by their names, or in a way that Spark's reader of text does not know. A file a task."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bz2
        import gzip

        def opened(raw: bytes) -> Any:
            if compression == "gzip":
                return gzip.GzipFile(fileobj=io.BytesIO(raw))
            if compression == "bz2":
                return bz2.BZ2File(io.BytesIO(raw))
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)

        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                held: list[str] = []
                for i, line in enumerate(io.TextIOWrapper(opened(raw), encoding="utf-8", newline="\n")):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 10_000:
                        yield pd.DataFrame({"value": held, "filename": path, "at": range(i + 1 - len(held), i + 1)})
                        held = []
                if held:
                    yield pd.DataFrame({"value": held, "filename": path, "at": range(i + 1 - len(held), i + 1)})

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(lines, "value string, filename string, at long")


def _lines_after(spark: SparkSession, files: list[str], skip: int) -> DataFrame:
    """(value, filename): the lines of text files but for the first ``skip`` of each, which are counted where the file's first block is read; blank lines go."""
    text = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("start"))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            first = b["start"] == 0
            place = b.groupby("filename").cumcount() + b["filename"].map(lambda f: seen.get(f, 0))
            for f, n in b[first]["filename"].value_counts().items():
                seen[f] = seen.get(f, 0) + int(n)
            yield b[~(first & (place < skip))][["value", "filename"]]

    return text.mapInPandas(drop, "value string, filename string").where("trim(value) <> ''")


def has_quoted_breaks(spark: SparkSession, files: list[str]) -> bool:
    """Whether some line has an odd number of quotes, so that a field goes over several lines: one parallel pass over the files."""
    return not spark.read.text(files).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").isEmpty()


def load_csv(
    spark: SparkSession, files: list[str], *, header: bool = True, delim: str | None = None, skip: int = 0, all_text: bool = False, auto_detect: bool = True, types: dict[str, str] | None = None, columns: list[str] | None = None,
    null_padding: bool = False, ignore_errors: bool = False, encoding: str | None = None, strict: bool = True, compression: str | None = None, file_name: bool = False, multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text. Types are inferred unless ``all_text``; ``types`` sets some; rows that do not fit are an error unless ``ignore_errors`` (they go) or ``null_padding``.

    Files are read in blocks by many tasks, unless fields hold line breaks (``multi_line``; if it is None, the files are looked through for them first). With ``skip``, or a ``compression``
    that the name does not tell, fields can't hold line breaks.
    """
    if compression not in (None, "none", "auto", "gzip", "zstd", "bz2"):
        raise ValueError(f"unknown compression {compression!r}")
    packed = compression if compression in ("gzip", "zstd", "bz2") and not all(f.endswith(_NATIVE.get(compression, "\0")) for f in files) else None
    if packed is None and files[0].endswith((".zst", ".zstd")):
        packed = "zstd"
    if packed:
        unpacked = _unpacked(spark, files, packed)
        head = [r.value for r in unpacked.where(F.col("at") < 20 + skip).orderBy("filename", "at").limit(20 + skip).collect()]
    else:
        head = _head(files[0], 20 + skip, encoding or "utf-8")
    d = delim or sniff_delimiter(head[skip:])
    mode = "DROPMALFORMED" if ignore_errors else "PERMISSIVE" if null_padding or not strict else "FAILFAST"
    options = {
        "sep": d, "escape": '"', "mode": mode, "nanValue": "NaN", "ignoreLeadingWhiteSpace": str(not all_text).lower(), "ignoreTrailingWhiteSpace": str(not all_text).lower(), "preferDate": "true",
        "timestampNTZFormat": "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS][.SSS]['Z']",
    }
    infer_types = not (all_text or not auto_detect)
    reader = spark.read.options(**options).option("inferSchema", infer_types)
    if skip or packed:
        n = skip + (1 if header else 0)
        lines = unpacked.where((F.col("at") >= n) & (F.trim("value") != "")).select("value", "filename") if packed else _lines_after(spark, files, n)
        schema = reader.option("header", False).csv(lines.select("value").rdd.map(lambda r: r[0])).schema
        names = next(csv.reader([head[skip]], delimiter=d)) if header and len(head) > skip else schema.fieldNames()
        names = [x if all_text else x.strip() for x in names]
        schema = T.StructType([T.StructField(x, schema[i].dataType if i < len(schema) else T.StringType()) for i, x in enumerate(names)])
        # rows are parsed where they lie, beside the name of their file
        parse = {**options, "mode": "PERMISSIVE" if mode == "DROPMALFORMED" else mode}
        read = lines.select(F.from_csv("value", _ddl(schema), parse).alias("r"), "filename").where("r is not null")
        df = read.select(*[F.col("r")[x].alias(x) for x in names], *(["filename"] if file_name else []))
    else:
        many = has_quoted_breaks(spark, files) if multi_line is None else multi_line
        reader = reader.option("header", header).option("multiLine", many)
        if encoding:
            reader = reader.option("encoding", encoding)
        df = reader.csv(files)
        if file_name:
            df = df.withColumn("filename", F.input_file_name())
    if infer_types:
        # whole numbers are 64 bits wide, as in other sources
        df = df.select(*[col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else col(f.name) for f in df.schema])
    if types:
        df = df.withColumns({c: col(c).cast(spark_type(t)) for c, t in types.items()})
    return df.select(*[col(c) for c in columns], *([F.col("filename")] if file_name and "filename" not in columns else [])) if columns else df


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema)


def _key_order(path: str) -> list[str]:
    """Keys in the order of their first appearance in the head of a file."""
    order: dict[str, None] = {}
    text = "\n".join(_head(path, 200))
    depth = 0
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"\s*(:)?|[\[\]{}]', text):
        t = m[0]
        if t in "[{":
            depth += t == "{"
        elif t in "]}":
            depth -= t == "}"
        elif m[2] and depth == 1:
            order.setdefault(json.loads(f'"{m[1]}"'))
    return list(order)


def load_json(spark: SparkSession, files: list[str], *, json_format: str | None = None, records: bool | str = "auto", columns: list[str] | None = None, file_name: bool = False) -> DataFrame:
    """Arrays of objects or an object a line; columns in the order in which the keys appear. Without ``records`` each object is one text in the column ``json``."""
    if json_format not in (None, "unstructured", "newlineDelimited", "array"):
        raise ValueError(f"unknown format {json_format!r}")
    head = "".join(_head(files[0], 5)).lstrip()
    many = json_format == "array" or (json_format in (None, "unstructured") and head.startswith("["))
    df = spark.read.option("multiLine", many).json(files)
    order = [c for c in _key_order(files[0]) if c in df.columns]
    df = df.select(*[col(c) for c in order], *[col(c) for c in df.columns if c not in order])
    if file_name:
        df = df.withColumn("filename", F.input_file_name())
    if records is False or records == "false":
        names = [c for c in df.columns if not (file_name and c == "filename")]
        df = df.select(F.to_json(F.struct(*[col(c) for c in names]), {"ignoreNullFields": "false"}).alias("json"), *(["filename"] if file_name else []))
    return df.select(*[col(c) for c in columns]) if columns else df


def load_parquet(spark: SparkSession, files: list[str], *, unify: bool = False, columns: list[str] | None = None, file_name: bool = False) -> DataFrame:
    df = spark.read.option("mergeSchema", unify).parquet(*files)
    if file_name:
        df = df.withColumn("filename", F.input_file_name())
    return df.select(*[col(c) for c in columns]) if columns else df


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_xlsx(path: str, sheet: str | None = None) -> list[list[Any]]:
    """Cells of one sheet, the first by default: texts, numbers and booleans; None where empty."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(_REL)] for s in book.findall("m:sheets/m:sheet", _NS)}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {list(sheets)}")
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[list[Any]] = []
    for row in root.findall("m:sheetData/m:row", _NS):
        cells: list[Any] = []
        for c in row.findall("m:c", _NS):
            ref = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref[0]))) - 1 if ref else len(cells)
            cells += [None] * (at - len(cells))
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
            elif v is None or v.text is None:
                cells.append(None)
            elif kind == "s":
                cells.append(shared[int(v.text)])
            elif kind == "b":
                cells.append(v.text == "1")
            elif kind in ("str", "e"):
                cells.append(v.text)
            else:
                cells.append(float(v.text))
        rows.append(cells)
    return rows


def load_excel(spark: SparkSession, path: str, *, sheet: str | None = None, header: bool = True, all_text: bool = False) -> DataFrame:
    rows = read_xlsx(path, sheet)
    width = max((len(r) for r in rows), default=0)
    rows = [r + [None] * (width - len(r)) for r in rows]
    names = [str(c) if c is not None else f"col{i}" for i, c in enumerate(rows[0])] if header and rows else [f"col{i}" for i in range(width)]
    data = [dict(zip(names, (None if x is None else f"{x:g}" if all_text and isinstance(x, float) else str(x) if all_text else x for x in r), strict=True)) for r in rows[1 if header else 0 :]]
    return load_rows(spark, data, names)


def infer(values: list[Any]) -> T.DataType:
    """The type of a column of Python values, from the first one that is not null; numbers are doubles. Texts among values of another kind make it a column of texts."""
    known = [v for v in values if v is not None and not (isinstance(v, float) and v != v)]
    if any(isinstance(v, str) for v in known):
        return T.StringType()
    for v in known:
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, (int, float, decimal.Decimal)):
            return T.DoubleType()
        if isinstance(v, str):
            return T.StringType()
        if isinstance(v, dt.datetime):
            return T.TimestampNTZType()
        if isinstance(v, dt.date):
            return T.DateType()
        if isinstance(v, dt.time):
            return T.TimeType(6)
        if isinstance(v, (bytes, bytearray)):
            return T.BinaryType()
        if isinstance(v, (list, tuple)) and all(isinstance(x, (int, float)) for x in v):
            return T.ArrayType(T.FloatType())
        raise ValueError(f"values of type {type(v).__name__} can't be loaded")
    return T.StringType()


def fit(v: Any, kind: T.DataType) -> Any:
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(v)
    if isinstance(kind, T.ArrayType):
        return [float(x) for x in v]
    if isinstance(kind, T.TimestampNTZType) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        return str(v)
    return v


def load_rows(spark: SparkSession, rows: list[dict[str, Any]], names: list[str] | None = None) -> DataFrame:
    """Rows in memory, in their order."""
    names = names or list(dict.fromkeys(k for r in rows for k in r))
    kinds = [infer([r.get(c) for r in rows]) for c in names]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)] + [T.StructField(ORD, T.LongType())])
    data = [tuple(fit(r.get(c), k) for c, k in zip(names, kinds, strict=True)) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def load_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a SQLite file."""
    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            cur = db.execute('SELECT * FROM "{}"'.format(name.replace('"', '""')))
            cols = [c[0] for c in cur.description]
            out[name] = load_rows(spark, [dict(zip(cols, r, strict=True)) for r in cur.fetchall()], cols)
    return out


_OPTIONS = {
    "csv": {"header", "delim", "skip", "all_text", "auto_detect", "types", "columns", "null_padding", "ignore_errors", "encoding", "strict", "compression", "file_name", "multi_line"}, "json": {"json_format", "records", "columns", "file_name"},
    "parquet": {"columns", "file_name"}, "excel": {"header", "all_text", "columns"},
}


def _check_options(kind: str, options: dict[str, Any]) -> None:
    name = "csv" if kind in ("csv", "dsv") else kind
    if name in _OPTIONS and (unknown := sorted(set(options) - _OPTIONS[name])):
        raise ValueError(f"{kind} files have no options {unknown}; there are {sorted(_OPTIONS[name])}")


def load(spark: SparkSession, files: str | list[str], *, file_type: str | None = None, limit: int | None = None, unify: bool = False, sheet: str | None = None, **options: Any) -> DataFrame:
    """Files of one type as one table in the order of their rows; ``unify`` fills columns that some files lack with nulls."""
    paths = listed(files)
    kind = kind_of(paths[0], file_type, options.get("delim"))
    _check_options(kind, options)
    if kind == "excel":
        if len(paths) != 1 or options.get("columns"):
            raise ValueError("one Excel file at a time, with all its columns")
        return load_excel(spark, paths[0], sheet=sheet, header=options.get("header", True), all_text=options.get("all_text", False))
    name = "csv" if kind in ("csv", "dsv") else kind
    if name not in _OPTIONS:
        raise ValueError(f"{kind} files are loaded by load_geo_data")
    args = dict(options)
    reader = {"csv": load_csv, "json": load_json, "parquet": load_parquet}[name]
    if name == "parquet":
        df = load_parquet(spark, paths, unify=unify, **args)
    elif len(paths) > 1 and (unify or name == "csv"):
        parts = [reader(spark, [p], **args) for p in paths]
        if not unify and any(set(p.columns) != set(parts[0].columns) for p in parts):
            raise ValueError("the files have different columns; use unify")
        df = None
        for p in parts:
            df = p if df is None else df.unionByName(p, allowMissingColumns=unify)
    else:
        df = reader(spark, paths, **args)
    return ordered(df.limit(limit) if limit is not None else df)


def load_directory(spark: SparkSession, directory: str, **options: Any) -> DataFrame:
    files = sorted(os.path.join(directory, f) for f in os.listdir(directory) if not f.startswith("."))
    if not files:
        raise ValueError(f"{directory} has no files")
    return load(spark, files, **options)


def to_csv_text(rows: list[dict[str, Any]], names: list[str]) -> str:
    """CSV text; a date or a time at midnight UTC is a date, other times are ISO with Z."""

    def shown(v: Any) -> Any:
        if isinstance(v, dt.datetime):
            return v.date().isoformat() if v.time() == dt.time(0) else v.isoformat(timespec="milliseconds") + "Z"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
            return int(v)
        return "" if v is None else v

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    w.writerows([[shown(r[c]) for c in names] for r in rows])
    return out.getvalue().rstrip("\n")
