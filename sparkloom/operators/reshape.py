"""Long and wide forms, nesting, repeating."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import INTEGERS, col, is_numeric, listed
from sparkloom.operators.columns import need
from sparkloom.operators.order import ORD, ordered, visible


def longer(df: DataFrame, columns: list[str], columns_to: str, values_to: str) -> DataFrame:
    """Columns become rows, nulls included: the other columns, then name, then value."""
    need(df, columns)
    kinds = [df.schema[c].dataType for c in columns]
    if all(k == kinds[0] for k in kinds):
        kind = kinds[0].simpleString()
    elif all(is_numeric(k) for k in kinds):
        kind = "bigint" if all(isinstance(k, INTEGERS) for k in kinds) else "double"
    else:
        kind = "string"
    rows = F.array(*[F.struct(F.lit(c).alias("n"), col(c).cast(kind).alias("v")) for c in columns])
    keep = [c for c in visible(df) if c not in columns]
    d = ordered(df)
    out = d.select(*[col(c) for c in keep], ORD, F.posexplode(rows).alias("__p", "__r"))
    # the place of each new row follows from its old row's place, without a sort
    bits = max(1, (len(columns) - 1).bit_length())
    place = F.shiftleft(ORD, bits) + F.col("__p")
    return out.select(*[col(c) for c in keep], F.col("__r.n").alias(columns_to), F.col("__r.v").alias(values_to), place.alias(ORD))


def wider(df: DataFrame, columns_from: str, values_from: str) -> DataFrame:
    """Values become columns named by another column, in its order; values that meet are added. Null names are dropped, empty cells are null."""
    need(df, [columns_from, values_from])
    names = [r[0] for r in df.select(col(columns_from)).where(col(columns_from).isNotNull()).distinct().orderBy(col(columns_from)).collect()]
    rest = [c for c in visible(df) if c not in (columns_from, values_from)]
    kind = df.schema[values_from].dataType
    value = F.sum(col(values_from)) if is_numeric(kind) else F.first(col(values_from), ignorenulls=True)
    grouped = df.where(col(columns_from).isNotNull()).groupBy(*[col(c) for c in rest])
    out = grouped.pivot(columns_from.replace(".", "`.`") if "." in columns_from else columns_from, names).agg(value)
    return out.orderBy(*[col(c).asc_nulls_last() for c in rest]) if rest else out


def nest(df: DataFrame, column: str, separator: str, categories: str | list[str]) -> DataFrame:
    """Texts of a group in one, in table order, without nulls; sorted by the categories."""
    cats = listed(categories)
    d = ordered(df)
    items = F.transform(F.sort_array(F.collect_list(F.when(col(column).isNotNull(), F.struct(F.col(ORD), col(column).cast("string").alias("x"))))), lambda s: s["x"])
    texts = F.when(F.size(items) > 0, F.array_join(items, separator))
    out = d.groupBy(*[col(c) for c in cats]).agg(texts.alias(column))
    return out.orderBy(*[col(c).asc_nulls_last() for c in cats])


def unnest(df: DataFrame, column: str, separator: str) -> DataFrame:
    """A row for each part of a text, trimmed, in the last column; rows without text vanish."""
    need(df, [column])
    rest = [c for c in df.columns if c != column]
    return df.select(*[col(c) for c in rest], F.explode(F.split(col(column), re.escape(separator))).alias(column)).withColumn(column, F.trim(col(column)))


def repeat_rows(df: DataFrame, column: str, index: str | None = None) -> DataFrame:
    """Each row as many times as its number says; none for zero, negative numbers and null."""
    need(df, [column])
    n = col(column).cast("int")
    out = df.withColumn(index or "__i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return out.withColumn(index, col(index).cast("bigint")) if index else out.drop("__i")
