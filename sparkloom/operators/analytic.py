"""Ranks, quantiles, running and rolling values, filling, proportions, scores, outliers, bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import INTEGERS, col, divide, listed, rounded
from sparkloom.operators.columns import need
from sparkloom.operators.order import ORD, by, framed, last_known, ordered, row_number, running_sum, settled
from sparkloom.storage import stored


def _partition(cats: str | list[str] | None):
    return Window.partitionBy(*[col(c) for c in listed(cats)])


def _with_group(df: DataFrame, cats: str | list[str] | None, **aggs: Column) -> DataFrame:
    """Columns with aggregates of each row's group, or of the table: an aggregation joined back, so that no window holds a whole table."""
    if listed(cats):
        return df.withColumns({n: a.over(_partition(cats)) for n, a in aggs.items()})
    # without groups: exactly one row, joined to every row
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggs.items()])))


def ranks(df: DataFrame, values: str, new: str, order: str = "asc", categories: str | list[str] | None = None, no_gaps: bool = False) -> DataFrame:
    """Ranks from 1, nulls last. Without categories the rank is the number of rows of lesser values, from an aggregation by value."""
    key = col(values).asc_nulls_last() if order == "asc" else col(values).desc_nulls_last()
    if listed(categories):
        rank = (F.dense_rank() if no_gaps else F.rank()).over(_partition(categories).orderBy(key))
        return df.withColumn(new, rank.cast("bigint"))
    counts = df.groupBy(col(values).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    k = F.col("__v").asc_nulls_last() if order == "asc" else F.col("__v").desc_nulls_last()
    placed = counts.orderBy(k).withColumn(ORD, F.monotonically_increasing_id())
    if no_gaps:
        placed = row_number(placed, "__r").withColumn("__r", F.col("__r") + 1)
    else:
        placed = running_sum(placed, "__c", "__s").withColumn("__r", F.col("__s") - F.col("__c") + 1)
    ranked = placed.select("__v", F.col("__r").cast("bigint").alias(new))
    return df.join(ranked, col(values).eqNullSafe(F.col("__v"))).drop("__v")


def quantiles(df: DataFrame, values: str, n: int, new: str, categories: str | list[str] | None = None) -> DataFrame:
    """Groups of equal size from 1 to n by value, nulls last; rows of one value are told apart by their order."""
    d = ordered(df)
    if listed(categories):
        out = d.withColumn(new, F.ntile(n).over(_partition(categories).orderBy(col(values).asc_nulls_last(), ORD)).cast("bigint"))
    else:
        sorted_ = d.withColumn("__ord0", F.col(ORD)).orderBy(col(values).asc_nulls_last(), ORD).withColumn(ORD, F.monotonically_increasing_id())
        numbered = row_number(sorted_, "__i").crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("__n"))))
        size, more = F.floor(F.col("__n") / n), F.col("__n") % n
        edge = more * (size + 1)
        tile = F.when(F.col("__i") < edge, F.floor(F.col("__i") / (size + 1))).otherwise(more + F.floor((F.col("__i") - edge) / F.greatest(size, F.lit(1)))) + 1
        out = numbered.withColumn(new, tile.cast("bigint")).withColumn(ORD, F.col("__ord0")).drop("__i", "__n", "__ord0")
    return out if ORD in df.columns else out.drop(ORD)


def accumulate(df: DataFrame, column: str, new: str, categories: str | list[str] | None = None) -> DataFrame:
    return running_sum(ordered(df), column, new, categories)


def rolling(df: DataFrame, column: str, new: str, summary: str, preceding: int, following: int, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """A statistic of neighbouring rows in table order; null unless the frame has all its rows and none is null."""
    if summary not in ("min", "max", "mean", "median", "sum"):
        raise ValueError(f"unknown summary {summary!r}")
    x, size = col(column), preceding + following + 1

    def make(d: DataFrame, w) -> DataFrame:
        if summary == "median":
            s = F.array_sort(F.collect_list(x).over(w))
            value = (F.element_at(s, (size + 1) // 2) + F.element_at(s, size // 2 + 1)) / 2.0
            value = F.when(F.size(s) == size, value)
        else:
            value = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[summary](x).over(w)
        return d.withColumn(new, F.when(F.count(x).over(w) == size, rounded(value, decimals)))

    return framed(ordered(df), preceding, following, categories, make)


def lead(df: DataFrame, column: str, new: str, offset: int = 1, categories: str | list[str] | None = None) -> DataFrame:
    """A copy of the column, ``offset`` rows up."""
    d = ordered(df)
    if listed(categories):
        return d.withColumn(new, F.lead(col(column), offset).over(by(categories)))
    back, forth = (0, offset) if offset >= 0 else (-offset, 0)
    return framed(d, back, forth, None, lambda x, w: x.withColumn(new, F.lead(col(column), offset).over(Window.partitionBy("__s").orderBy("__n"))))


def fill(df: DataFrame, columns: str | list[str], categories: str | list[str] | None = None) -> DataFrame:
    """Nulls take the last value before them, in table order."""
    df = ordered(df)
    names = df.columns
    for c in listed(columns):
        need(df, [c])
        df = last_known(df, c, "__fill", categories).withColumn(c, F.col("__fill")).drop("__fill")
    return df.select(*[col(c) for c in names])


def interpolate(df: DataFrame, columns: str | list[str], categories: str | list[str] | None = None, along: str | None = None) -> DataFrame:
    """Nulls between and beyond known values lie on the line through the two nearest known ones, over the row number or the column ``along``; a column of integers is cut to integers."""
    df = settled(ordered(df))
    names = df.columns
    for c in listed(columns):
        need(df, [c])
        kind = df.schema[c].dataType
        if along is None:
            d = row_number(df, "__x", categories).withColumn("__x", F.col("__x").cast("double"))
        else:
            time = isinstance(df.schema[along].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            d = df.withColumn("__x", F.unix_micros(col(along).cast("timestamp")).cast("double") if time else col(along).cast("double"))
            d = d.withColumn("__keep", F.col(ORD))
            if listed(categories):
                d = d.withColumn(ORD, F.row_number().over(_partition(categories).orderBy("__x", ORD)).cast("bigint"))
            else:
                d = d.orderBy("__x", ORD).withColumn(ORD, F.monotonically_increasing_id())
        d = settled(d)
        here = F.when(col(c).isNotNull(), F.struct(F.col("__x").alias("x"), col(c).cast("double").alias("y")))
        d = d.withColumn("__h", here)
        d = last_known(d, "__h", "__a", categories)
        d = last_known(d, "__h", "__b", categories, back=True)
        # before the first and beyond the last known point the line goes through the two at that end
        d = _with_ends(d, categories)
        p = F.coalesce(F.when(F.col("__b").isNotNull(), F.col("__a")), F.when(F.col("__b").isNull(), F.col("__p2")), F.col("__b"))
        r = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__b")).when(F.col("__a").isNotNull(), F.col("__a")).otherwise(F.col("__n2"))
        line = F.when(F.col("__h").isNotNull(), F.col("__h.y")).otherwise(
            F.when(r.isNull() | (p["x"] == r["x"]), F.coalesce(p["y"], r["y"])).otherwise(p["y"] + (r["y"] - p["y"]) * (F.col("__x") - p["x"]) / F.when(p["x"] != r["x"], r["x"] - p["x"]))
        )
        value = line.cast(kind) if not isinstance(kind, INTEGERS) else F.when(line >= 0, F.floor(line)).otherwise(F.ceil(line)).cast(kind)
        d = d.withColumn(c, F.when(F.col("__x").isNull(), col(c)).otherwise(value))
        df = d.withColumn(ORD, F.col("__keep")) if along is not None else d
        df = df.select(*[col(x) for x in names])
    return df


def _with_ends(d: DataFrame, cats: str | list[str] | None) -> DataFrame:
    """Adds the second known point of each group and the last but one, from two small aggregations."""
    names = listed(cats)
    known = d.where(F.col("__h").isNotNull()).select(*[col(c) for c in names], ORD, "__h")
    ends = known.groupBy(*[col(c) for c in names]).agg(F.min(ORD).alias("__f"), F.max(ORD).alias("__l"))
    inner = (known.join(ends, names) if names else known.crossJoin(F.broadcast(ends))).groupBy(*[col(c) for c in names]).agg(
        F.min_by("__h", F.when(F.col(ORD) > F.col("__f"), F.col(ORD))).alias("__n2"), F.max_by("__h", F.when(F.col(ORD) < F.col("__l"), F.col(ORD))).alias("__p2")
    )
    return d.join(inner, names, "left") if names else d.crossJoin(F.broadcast(inner))


def proportions_horizontal(df: DataFrame, columns: list[str], suffix: str = "Perc", decimals: int | None = None) -> DataFrame:
    """Each column's share of the row's sum; null if any is null."""
    need(df, columns)
    total = sum((col(c).cast("double") for c in columns), F.lit(0.0))
    return df.withColumns({f"{c}{suffix}": rounded(divide(col(c), total), decimals) for c in columns})


def proportions_vertical(df: DataFrame, column: str, new: str, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Each value's share of the column's sum."""
    d = _with_group(df, categories, __t=F.sum(col(column)))
    return d.withColumn(new, rounded(divide(col(column), F.col("__t")), decimals)).drop("__t")


def z_score(df: DataFrame, column: str, new: str, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Distance from the mean in population standard deviations."""
    d = _with_group(df, categories, __m=F.avg(col(column)), __s=F.stddev_pop(col(column)))
    return d.withColumn(new, rounded(divide(col(column) - F.col("__m"), F.col("__s")), decimals)).drop("__m", "__s")


def normalize(df: DataFrame, column: str, new: str, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """From 0 for the least to 1 for the greatest value."""
    d = _with_group(df, categories, __a=F.min(col(column)), __b=F.max(col(column)))
    return d.withColumn(new, rounded(divide(col(column) - F.col("__a"), F.col("__b") - F.col("__a")), decimals)).drop("__a", "__b")


def exact_quantiles(df: DataFrame, column: str, shares: list[float], discrete: bool = False) -> list[float | None]:
    """Exact quantiles of a whole column: values are counted, sorted by range and counted up run by run, so no task holds them all; only the values at the wanted places come back."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # the distinct values, sorted and numbered once; the rest reads them
    placed = stored(counts.orderBy("v").withColumn(ORD, F.monotonically_increasing_id()))
    n = placed.agg(F.sum("c")).first()[0]
    if not n:
        return [None] * len(shares)
    places: set[int] = set()
    for q in shares:
        at = max(0, math.ceil(q * n) - 1) if discrete else (n - 1) * q
        places |= {math.floor(at), math.ceil(at)}
    upto = running_sum(placed, "c", "s")
    hit = F.exists(F.array(*[F.lit(p) for p in sorted(places)]), lambda p: (p < F.col("s")) & (p >= F.col("s") - F.col("c")))
    rows = upto.where(hit).select("v", "s", "c").collect()
    value = {p: next(r.v for r in rows if r.s - r.c <= p < r.s) for p in places}
    out: list[float | None] = []
    for q in shares:
        at = max(0, math.ceil(q * n) - 1) if discrete else (n - 1) * q
        a, b = value[math.floor(at)], value[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def outliers_iqr(df: DataFrame, column: str, new: str, categories: str | list[str] | None = None) -> DataFrame:
    """Whether a value is farther than 1.5 interquartile ranges from the quartiles: discrete ones if the table has an even number of rows, else continuous."""
    cats = listed(categories)
    kind = "percentile_disc" if df.count() % 2 == 0 else "percentile_cont"
    if not cats:
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75], kind == "percentile_disc")
        if q1 is None or q3 is None:
            return df.withColumn(new, F.lit(False))
        reach = 1.5 * (q3 - q1)
        return df.withColumn(new, F.coalesce((col(column) > q3 + reach) | (col(column) < q1 - reach), F.lit(False)))
    name = "`" + column.replace("`", "``") + "`"
    q = {f"__q{i}": F.expr(f"{kind}({p}) within group (order by cast({name} as double))") for i, p in ((1, 0.25), (3, 0.75))}
    bounds = df.groupBy(*[col(c) for c in cats]).agg(*[e.alias(n) for n, e in q.items()])
    d = df.join(bounds, cats, "left")
    gap = F.col("__q3") - F.col("__q1")
    far = (col(column) > F.col("__q3") + 1.5 * gap) | (col(column) < F.col("__q1") - 1.5 * gap)
    return d.withColumn(new, F.coalesce(far, F.lit(False))).select(*[col(c) for c in df.columns if c != new], col(new))


def bins(df: DataFrame, values: str, interval: float, new: str, start: float | None = None) -> DataFrame:
    """Labels [from-to] of intervals; ``to`` is the last value before the next interval at the interval's precision."""
    low, high = df.agg(F.min(col(values)).cast("double"), F.max(col(values)).cast("double")).first()
    if low is None:
        return df.withColumn(new, F.lit(None).cast("string"))
    begin = low if start is None else float(start)
    if begin > low:
        raise ValueError(f"the start {begin} is greater than the least value {low}")
    decimals = len(str(interval).split(".")[1].rstrip("0")) if isinstance(interval, float) and interval != int(interval) else 0
    step = 1.0 if decimals == 0 else 1 / (10 * decimals)
    # the number of the interval; exact to the precision of its bounds
    i = F.floor((col(values).cast("double") - F.lit(begin)) / F.lit(float(interval)) + F.lit(1e-9))
    places = max(decimals, len(str(begin).split(".")[1].rstrip("0")) if "." in str(begin) else 0, 0 if decimals == 0 else len(f"{step:.10f}".rstrip("0").split(".")[1]))
    text = lambda x: F.regexp_replace(F.format_number(x, places).cast("string"), ",", "") if places == 0 else F.regexp_replace(F.regexp_replace(F.format_number(x, places), ",", ""), r"\.?0+$", "")
    a = F.lit(begin) + i * F.lit(float(interval))
    b = a + F.lit(float(interval)) - F.lit(step)
    label = F.concat(F.lit("["), text(a), F.lit("-"), text(b), F.lit("]"))
    return df.withColumn(new, F.when(col(values).isNotNull() & (col(values).cast("double") <= b + F.lit(1e-9)), label))
