"""Projection and changes of columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import col, listed
from sparkloom.functions.sqltext import rewrite
from sparkloom.functions.types import converted, spark_type
from sparkloom.operators.order import ORD, visible


def need(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; there are {visible(df)}")


def select(df: DataFrame, columns: str | list[str]) -> DataFrame:
    need(df, listed(columns))
    return df.select(*[col(c) for c in listed(columns)], *[F.col(c) for c in df.columns if c == ORD])


def drop(df: DataFrame, columns: str | list[str]) -> DataFrame:
    need(df, listed(columns))
    return df.drop(*[col(c) for c in listed(columns)])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One after another, so later pairs see the earlier ones' results."""
    for old, new in names.items():
        need(df, [old])
        df = df.select(*[col(c).alias(new) if c == old else col(c) for c in df.columns])
    return df


def camel(name: str) -> str:
    parts = re.sub(r"[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+", " ", name).split()
    return "".join(p.lower() if i == 0 else p[:1].upper() + p[1:].lower() for i, p in enumerate(parts))


def clean_names(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) if c == ORD else col(c).alias(camel(c)) for c in df.columns])


def add(df: DataFrame, name: str, kind: str, expression: str) -> DataFrame:
    return df.withColumn(name, F.expr(rewrite(expression)).cast(spark_type(kind)))


def update(df: DataFrame, name: str, expression: str) -> DataFrame:
    need(df, [name])
    return df.withColumn(name, F.expr(rewrite(expression)).cast(df.schema[name].dataType))


def clone(df: DataFrame, name: str, new: str) -> DataFrame:
    need(df, [name])
    return df.withColumn(new, col(name))


def convert(df: DataFrame, types: dict[str, str], lenient: bool = False, fmt: str | None = None) -> DataFrame:
    need(df, list(types))
    return df.withColumns({c: converted(c, df.schema[c].dataType, t, lenient=lenient, fmt=fmt) for c, t in types.items()})
