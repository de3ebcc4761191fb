"""Joins: equi, cross, semi, anti, range, as-of. Catalyst picks the physical join from sizes; nothing is forced to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.exprs import col, listed
from sparkloom.operators.order import ORD, last_known, visible


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in visible(left) if c in visible(right)]


def join(left: DataFrame, right: DataFrame, on: str | list[str] | None = None, how: str = "left") -> DataFrame:
    """All columns of the left, then the right's without its key. A right row without partner has a null key.

    Without ``on`` the tables must share exactly one column; other columns of one name are an error.
    """
    shared = common_columns(left, right)
    keys = listed(on)
    if not keys:
        if len(shared) != 1:
            raise ValueError(f"name the common column: the tables share {shared}")
        keys = shared
    clash = [c for c in shared if c not in keys]
    if clash:
        raise ValueError(f"both tables have {clash}; rename them first")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how!r}")
    r = right.drop(ORD).select(*[col(c).alias(f"__key{keys.index(c)}") if c in keys else col(c) for c in visible(right)])
    cond = [col(k) == F.col(f"__key{i}") for i, k in enumerate(keys)]
    out = left.join(r, cond, how)
    out = out.drop(*[f"__key{i}" for i in range(len(keys))])
    # rows without a left partner come after the others
    return out.withColumn(ORD, F.coalesce(F.col(ORD), F.lit(1 << 62) + F.monotonically_increasing_id())) if ORD in out.columns and how in ("right", "full") else out


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    clash = common_columns(left, right)
    if clash:
        raise ValueError(f"both tables have {clash}; rename them first")
    return left.crossJoin(right.drop(ORD))


def semi_join(left: DataFrame, right: DataFrame, on: str | list[str], anti: bool = False) -> DataFrame:
    return left.join(right.select(*[col(c) for c in listed(on)]), listed(on), "left_anti" if anti else "left_semi")


def as_of_join(left: DataFrame, right: DataFrame, time: str, on: str | list[str] | None = None, right_time: str | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time, within the keys: union, one sort, the last known right row. Left rows without one get nulls."""
    keys, rt = listed(on), right_time or time
    l_cols = left.columns
    r_cols = [c for c in visible(right) if c not in keys and c != rt]
    packed = F.struct(*[col(c) for c in r_cols])
    l = left.select(*[col(c) for c in keys], col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[col(c) for c in l_cols]).alias("__l"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("__r"))
    r = right.select(*[col(c) for c in keys], col(rt).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), packed.alias("__r"))
    both = l.unionByName(r)
    if keys:
        w = Window.partitionBy(*[col(c) for c in keys]).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w))
    else:
        # without keys: a sort by range, and the last known row carried from run to run
        placed = both.orderBy("__t", "__side").withColumn(ORD, F.monotonically_increasing_id())
        both = last_known(placed, "__r", "__last").drop("__r").withColumnRenamed("__last", "__r")
    both = both.where("__side = 1")
    return both.select(*[F.col("__l")[c].alias(c) for c in l_cols], *[F.col("__r")[c].alias(c) for c in r_cols])


def range_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, bin_width: float, on: str | list[str] | None = None) -> DataFrame:
    """Left rows whose point is in [start, end) of a right row: both sides are put into cells of a quarter of ``bin_width``, so that it is an equi-join.

    The result may have far more rows than both sides, so the left is spread over ``spark.sql.shuffle.partitions`` tasks, however small it is.
    """
    keys = listed(on)
    cell = lambda c: F.floor(col(c) / F.lit(bin_width / 4))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l = left.withColumn("__bin", cell(point)).repartition(tasks, *[col(k) for k in keys], F.col("__bin"))
    r = right.drop(ORD).where(col(end) > col(start))
    r = r.withColumn("__bin", F.explode(F.sequence(cell(start), cell(end))))
    out = l.join(r, [*keys, "__bin"]).where((col(point) >= col(start)) & (col(point) < col(end)))
    return out.drop("__bin")
