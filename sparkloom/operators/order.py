"""Row order. A table's rows carry a hidden increasing number; operators that need order use it, others never sort.

The number's upper bits name a *run* of consecutive rows (a partition at the time of numbering), so running totals and row numbers over a whole table are
computed run by run in parallel, with one small table of offsets, instead of in one task. Rows and offsets are two readings of one plan, so the plan must
number its rows alike each time. One that only reads files and works row by row does; one with a sort or another shuffle does not (its partitions follow
sampled bounds and sizes at run time), so ``settled`` stores its rows first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.functions.exprs import col, listed
from sparkloom.storage import stored

ORD = "__ord"
_RUN = "__run"

#: Plans of these nodes alone give the same rows in the same partitions whenever they run.
_ROW_BY_ROW = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View", "Union", "Generate", "OneRowRelation", "Range"}


def ordered(df: DataFrame) -> DataFrame:
    """With the order of the rows as they are read."""
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def renumbered(df: DataFrame) -> DataFrame:
    """Numbers anew, after a sort or a change of rows."""
    return df.drop(ORD).withColumn(ORD, F.monotonically_increasing_id())


def _row_by_row(plan) -> bool:
    if plan.nodeName().split(" ")[0] not in _ROW_BY_ROW:
        return False
    kids = plan.children()
    return all(_row_by_row(kids.apply(i)) for i in range(kids.size()))


def row_by_row(df: DataFrame) -> bool:
    """Whether the plan only reads and works row by row: no shuffle, nothing that depends on the order in which rows arrive."""
    return _row_by_row(df._jdf.queryExecution().analyzed())


def settled(df: DataFrame) -> DataFrame:
    """Rows that can be read twice: as they are where the plan gives the same numbers each time, else stored in the shared folder (this runs the plan)."""
    return df if row_by_row(df) else stored(df)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(ORD) if ORD in df.columns else df


def by(cats: str | list[str] | None) -> WindowSpec:
    return Window.partitionBy(*[col(c) for c in listed(cats)]).orderBy(ORD)


def _by_run(df: DataFrame, total: Column, before: Callable[[WindowSpec], Column], make: Callable[[DataFrame], DataFrame], back: bool = False) -> DataFrame:
    """``df`` with ``make``'s columns and ``__before``: ``before``, over the ``total`` of each run as ``__t``, of the runs before the row's own.

    ``df`` is settled by the caller. The table of totals has a row for each run, that is for each partition. The rows lie by run already when they meet
    it, so the join moves nothing but the totals.
    """
    runs = df.withColumn(_RUN, F.shiftright(ORD, 33))
    totals = runs.groupBy(_RUN).agg(total.alias("__t"))
    earlier = Window.orderBy(F.desc(_RUN) if back else F.asc(_RUN)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_RUN, F.struct(before(earlier).alias("v")).alias("__o"))
    out = make(runs).join(offsets, _RUN, "left")
    # a run without a total would mean that the two readings differ
    whole = F.when(F.col("__o").isNull(), F.raise_error(F.lit("the order of the rows changed while they were numbered")).cast("boolean")).otherwise(F.lit(True))
    return out.where(whole).withColumn("__before", F.col("__o.v")).drop("__o", _RUN)


def row_number(df: DataFrame, name: str, cats: str | list[str] | None = None) -> DataFrame:
    """Numbers from 0, in table order, within categories if given."""
    if listed(cats):
        return df.withColumn(name, F.row_number().over(by(cats)).cast("bigint") - 1)
    names = [c for c in df.columns if c != name]
    inside = F.row_number().over(Window.partitionBy(_RUN).orderBy(ORD)).cast("bigint") - 1
    out = _by_run(settled(df), F.count(F.lit(1)), lambda w: F.sum("__t").over(w), lambda d: d.withColumn("__in", inside))
    return out.select(*[col(c) for c in names], (F.col("__in") + F.coalesce(F.col("__before"), F.lit(0))).alias(name))


def running_sum(df: DataFrame, value: str, name: str, cats: str | list[str] | None = None) -> DataFrame:
    """Sum of a column up to each row."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if listed(cats):
        return df.withColumn(name, F.sum(col(value)).over(by(cats).rowsBetween(*upto)))
    names = [c for c in df.columns if c != name]
    inside = F.sum(col(value)).over(Window.partitionBy(_RUN).orderBy(ORD).rowsBetween(*upto))
    out = _by_run(settled(df), F.sum(col(value)), lambda w: F.sum("__t").over(w), lambda d: d.withColumn("__in", inside))
    total = F.when(F.col("__in").isNull(), F.col("__before")).otherwise(F.col("__in") + F.coalesce(F.col("__before"), F.lit(0)))
    return out.select(*[col(c) for c in names], total.alias(name))


def last_known(df: DataFrame, value: str | Column, name: str, cats: str | list[str] | None = None, back: bool = False) -> DataFrame:
    """The last value that is not null up to each row (``back``: the first from each row on)."""
    x = col(value) if isinstance(value, str) else value
    order = F.desc(ORD) if back else F.asc(ORD)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if listed(cats):
        w = Window.partitionBy(*[col(c) for c in listed(cats)]).orderBy(order).rowsBetween(*upto)
        return df.withColumn(name, F.last(x, ignorenulls=True).over(w))
    names = [c for c in df.columns if c != name]
    d = settled(df).withColumn("__val", x)
    end = (F.min_by if back else F.max_by)("__val", F.when(F.col("__val").isNotNull(), F.col(ORD)))
    inside = F.last("__val", ignorenulls=True).over(Window.partitionBy(_RUN).orderBy(order).rowsBetween(*upto))
    out = _by_run(d, end, lambda w: F.last("__t", ignorenulls=True).over(w), lambda d: d.withColumn("__in", inside), back)
    return out.select(*[col(c) for c in names], F.coalesce("__in", "__before").alias(name))


def framed(df: DataFrame, preceding: int, following: int, cats: str | list[str] | None, make) -> DataFrame:
    """Applies ``make(df, window)`` with a frame of neighbouring rows.

    Without categories, rows are cut into stretches and each stretch gets copies of the few rows before and after it, so that stretches are computed apart.
    """
    if listed(cats):
        return make(df, by(cats).rowsBetween(-preceding, following))
    length = max(50_000, 50 * (preceding + following + 1))
    n = row_number(df, "__n")
    own = F.floor(F.col("__n") / length)
    first, last = F.floor((F.col("__n") - following) / length), F.floor((F.col("__n") + preceding) / length)
    spread = n.withColumn("__s", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("__own", own)
    out = make(spread, Window.partitionBy("__s").orderBy("__n").rowsBetween(-preceding, following))
    return out.where("__s = __own").drop("__s", "__own", "__n")
