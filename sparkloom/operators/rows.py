"""Filters, row selection, sorting, sampling, deduplication, appending."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import col, listed
from sparkloom.functions.sqltext import rewrite
from sparkloom.operators.order import ORD, in_order, ordered, renumbered, row_number, visible
from sparkloom.sources.files import fit

MISSING = ("undefined", "NaN", "null", "NULL", "")


def filter_rows(df: DataFrame, conditions: str) -> DataFrame:
    return df.where(F.expr(rewrite(conditions, condition=True)))


def remove_rows(df: DataFrame, conditions: str) -> DataFrame:
    """Rows for which the condition holds go; those for which it is null stay."""
    return df.where(~F.coalesce(F.expr(rewrite(conditions, condition=True)), F.lit(False)))


def keep(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    for name, v in values.items():
        df = df.where(col(name).isin(v if isinstance(v, (list, tuple)) else [v]))
    return df


def remove(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """SQL's NOT IN: a null cell goes too, and a null among the values removes every row."""
    for name, v in values.items():
        df = df.where(~col(name).isin(v if isinstance(v, (list, tuple)) else [v]))
    return df


def remove_missing(df: DataFrame, columns: str | list[str] | None = None, missing: list | tuple = MISSING, invert: bool = False) -> DataFrame:
    """Rows with a null or a missing value in any of the columns go; with ``invert`` only they stay."""
    texts = [v for v in missing if isinstance(v, str)]
    numbers = [v for v in missing if isinstance(v, (int, float)) and not isinstance(v, bool)]
    tests: list[Column] = []
    for name in listed(columns) or visible(df):
        kind, bad = df.schema[name].dataType, col(name).isNull()
        if isinstance(kind, T.StringType) and texts:
            bad = bad | col(name).isin(texts)
        if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)) and numbers:
            bad = bad | col(name).isin(numbers)
        tests.append(F.coalesce(bad, F.lit(True)))
    any_bad = reduce(lambda a, b: a | b, tests)
    return df.where(any_bad if invert else ~any_bad)


def remove_duplicates(df: DataFrame, on: str | list[str] | None = None) -> DataFrame:
    """One of equal rows stays; with ``on``, the first row of each combination."""
    names = listed(on) or visible(df)
    if ORD not in df.columns:
        return df.dropDuplicates(names)
    # the least of whole rows by order: a partial aggregation instead of a window's sort
    rest = [c for c in df.columns if c not in names and c != ORD]
    if not rest:
        return df.groupBy(*[col(c) for c in names]).agg(F.min(ORD).alias(ORD)).select(*[col(c) for c in df.columns])
    first = df.groupBy(*[col(c) for c in names]).agg(F.min_by(F.struct(*[col(c) for c in rest]), ORD).alias("__r"), F.min(ORD).alias(ORD))
    return first.select(*[col(c) if c in names or c == ORD else F.col("__r")[c].alias(c) for c in df.columns])


def select_rows(df: DataFrame, count: int | str, offset: int = 0) -> DataFrame:
    if isinstance(count, str):
        share = float(count.rstrip("%")) / 100
        count = int(df.count() * share)
    d = in_order(df)
    return (d.offset(offset) if offset else d).limit(count)


def skip(df: DataFrame, n: int) -> DataFrame:
    """All but the first n rows."""
    if ORD not in df.columns:
        return df.offset(n)
    return row_number(df, "__i").where(F.col("__i") >= n).drop("__i")


def sample(df: DataFrame, quantity: int | str, seed: int | None = None) -> DataFrame:
    """Exactly n rows, or n % of them, at random; the same ones for the same seed. A hash of the row's place decides, so only the n least are sorted."""
    if isinstance(quantity, str):
        quantity = int(df.count() * float(quantity.rstrip("%")) / 100)
    d = ordered(df)
    chance = F.xxhash64(F.lit(seed), ORD) if seed is not None else F.rand()
    picked = d.withColumn("__c", chance).orderBy("__c", ORD).limit(quantity).drop("__c")
    return picked if ORD in df.columns else picked.drop(ORD)


def sort(df: DataFrame, order: dict[str, str] | None = None, lang: dict[str, str] | None = None) -> DataFrame:
    """Nulls last both ways; without ``order`` by all columns from the left. ``lang`` names a locale for a column's texts."""
    keys = []
    for name, way in (order or dict.fromkeys(visible(df), "asc")).items():
        c = F.collate(col(name), lang[name]) if lang and name in lang else col(name)
        keys.append(c.asc_nulls_last() if way.lower() == "asc" else c.desc_nulls_last())
    if ORD in df.columns:
        return renumbered(df.orderBy(*keys, ORD))
    return df.orderBy(*keys)


def top_k(df: DataFrame, order: dict[str, str], k: int) -> DataFrame:
    """sort + select_rows as one heap per task instead of a whole sort."""
    keys = [col(c).asc_nulls_last() if way.lower() == "asc" else col(c).desc_nulls_last() for c, way in order.items()]
    return df.orderBy(*keys).limit(k)


def insert_rows(df: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    names = visible(df)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in names])
    extra = set().union(*rows) - set(names) if rows else set()
    if extra:
        raise ValueError(f"no such columns: {sorted(extra)}")
    new = df.sparkSession.createDataFrame([tuple(fit(r.get(c), df.schema[c].dataType) for c in names) for r in rows], schema)
    return append(df, [new])


def append(df: DataFrame, others: list[DataFrame], unify: bool = False) -> DataFrame:
    """Rows of other tables after those of ``df``, by column name. Columns and types must agree unless ``unify`` fills what is missing with nulls."""
    parts = [df, *others]
    if not unify:
        want = {c: df.schema[c].dataType for c in visible(df)}
        for o in others:
            have = {c: o.schema[c].dataType for c in visible(o)}
            if have != want:
                raise ValueError(f"columns or types differ: {have} and {want}")
    out: DataFrame | None = None
    for i, p in enumerate(parts):
        numbered = ordered(p).withColumn("__part", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=unify)
    # the runs of a part are moved beyond those of the parts before it; the bit from which parts are told apart is kept with the column
    bit = max([55, *[p.schema[ORD].metadata.get("bit", 55) for p in parts if ORD in p.columns]])
    if len(parts) > 15 or bit > 58:
        return renumbered(out.orderBy("__part", ORD).drop("__part"))
    moved = F.col("__part").cast("bigint") * F.lit(1 << bit) + F.col(ORD)
    return out.withColumn(ORD, moved.alias(ORD, metadata={"bit": bit + 4})).drop("__part")


def intersect(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    a, b = a.select(*[col(c) for c in visible(a)]), b.select(*[col(c) for c in visible(b)])
    return a.intersectAll(b) if all_rows else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, all_rows: bool = False) -> DataFrame:
    a, b = a.select(*[col(c) for c in visible(a)]), b.select(*[col(c) for c in visible(b)])
    return a.exceptAll(b) if all_rows else a.subtract(b)


def by_rank(df: DataFrame, cats: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*[col(c) for c in cats]).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
