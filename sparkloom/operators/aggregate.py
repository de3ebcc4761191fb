"""Summaries, correlations, regressions: one aggregation over the data, then a small reshaping of its result."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import TEMPORAL, col, is_numeric, listed, rounded, sample_skewness
from sparkloom.operators.order import row_by_row, visible

STATISTICS = ("count", "countUnique", "countNull", "min", "max", "mean", "median", "sum", "skew", "stdDev", "var")


def _promoted(kinds: list[T.DataType]) -> str:
    """One type for a column that gathers values of several columns."""
    if all(isinstance(k, type(kinds[0])) and k == kinds[0] for k in kinds):
        return kinds[0].simpleString()
    if all(is_numeric(k) for k in kinds):
        return "double" if any(isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)) for k in kinds) else "bigint"
    if all(isinstance(k, TEMPORAL) for k in kinds):
        return "timestamp_ntz"
    return "string"


def statistic(name: str, stat: str, kind: T.DataType) -> Column:
    """One statistic of a column; null where it has no meaning for the type."""
    x = col(name)
    number, time = is_numeric(kind), isinstance(kind, TEMPORAL)
    if stat == "count":
        return F.count(F.lit(1)).cast("int")
    if stat == "countUnique":
        return F.countDistinct(x).cast("int")
    if stat == "countNull":
        return F.count_if(x.isNull()).cast("int")
    if stat in ("min", "max") and (number or time or isinstance(kind, (T.TimeType, T.BooleanType))):
        return F.min(x) if stat == "min" else F.max(x)
    if stat == "median" and time:
        return F.timestamp_micros(F.median(F.unix_micros(x.cast("timestamp"))).cast("bigint")).cast("timestamp_ntz")
    if not number:
        return F.lit(None).cast("double")
    d = x.cast("double")
    return {"min": F.min(x), "max": F.max(x), "mean": F.avg(x).cast("double"), "median": F.median(d), "sum": F.sum(x), "skew": sample_skewness(d), "stdDev": F.stddev_samp(d), "var": F.var_samp(d)}[stat]


def summarize(
    df: DataFrame, values: str | list[str] | None = None, categories: str | list[str] | None = None, summaries: str | list[str] | dict[str, str] | None = None,
    decimals: int | None = None, to_ms: bool = False, no_value_column: bool = False,
) -> DataFrame:
    """One row for each value column and group, with a column for each statistic, in the order of value and categories.

    ``summaries`` may be a dict {new name: statistic}. Without ``values`` all columns that are no categories are summarised, or the rows are counted if there are none.
    All values are aggregated in one pass over the data; the long form is made from the result.
    """
    cats = listed(categories)
    names = [c for c in (listed(values) or [c for c in visible(df) if c not in cats]) if c not in cats]
    stats = dict(summaries) if isinstance(summaries, dict) else {s: s for s in listed(summaries) or STATISTICS}
    unknown = set(stats.values()) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    kinds = {c: df.schema[c].dataType for c in names}
    if to_ms:
        times = [c for c, k in kinds.items() if isinstance(k, TEMPORAL)]
        df = df.withColumns({c: F.unix_millis(col(c).cast("timestamp")).cast("double") for c in times})
        kinds |= dict.fromkeys(times, T.DoubleType())
    if not names:
        out = df.groupBy(*[col(c) for c in cats]).agg(F.count(F.lit(1)).cast("int").alias(next(iter(stats), "count")))
        return out.orderBy(*[col(c).asc_nulls_last() for c in cats]) if cats else out
    if any(isinstance(k, TEMPORAL) for k in kinds.values()) and any(is_numeric(k) for k in kinds.values()) and {"min", "max", "median"} & set(stats.values()):
        raise ValueError("dates and numbers can't be summarised in one column; use to_ms or separate calls")
    wide = _wide(df, cats, names, list(stats.values()), kinds)
    fields = []
    for j, (new, s) in enumerate(stats.items()):
        of = [wide.schema[f"__{i}_{j}"].dataType for i, c in enumerate(names)]
        known = [k for k, c in zip(of, names, strict=True) if not (isinstance(kinds[c], T.StringType) and s not in ("count", "countUnique", "countNull"))] or of
        fields.append((new, _promoted(known), s))
    rows = F.array(*[F.struct(F.lit(c).alias("value"), *[col(f"__{i}_{j}").cast(kind).alias(new) for j, (new, kind, _) in enumerate(fields)]) for i, c in enumerate(names)])
    long = wide.select(*[col(c) for c in cats], F.explode(rows).alias("__r"))
    out = long.select(F.col("__r.value").alias("value"), *[col(c) for c in cats], *[F.col("__r")[new].alias(new) for new, _, _ in fields])
    if decimals is not None:
        out = out.withColumns({new: rounded(col(new).cast("double"), decimals) for new, kind, s in fields if kind in ("double", "float") or (kind.startswith("decimal") and s not in ("count", "countUnique", "countNull"))})
    out = out.orderBy("value", *[col(c).asc_nulls_last() for c in cats])
    return out.drop("value") if no_value_column else out


def _wide(df: DataFrame, cats: list[str], names: list[str], stats: list[str], kinds: dict[str, T.DataType]) -> DataFrame:
    """One row a group, with the j-th statistic of the i-th column as ``__i_j``.

    Distinct values and medians of a table that is read straight from its files come from counts of the values, column by column: each is a scan of one column, whose
    partial counts are small, instead of one expansion of all rows by all columns. A plan that is not cheap to repeat is aggregated in one pass.
    """
    groups = [col(c) for c in cats]
    by_count = {(i, j) for i, c in enumerate(names) for j, s in enumerate(stats) if s == "countUnique" or (s == "median" and (is_numeric(kinds[c]) or isinstance(kinds[c], TEMPORAL)))} if row_by_row(df) else set()
    simple = [statistic(c, s, kinds[c]).alias(f"__{i}_{j}") for i, c in enumerate(names) for j, s in enumerate(stats) if (i, j) not in by_count]
    out = df.groupBy(*groups).agg(*(simple or [F.count(F.lit(1)).alias("__all")]))
    for i, c in enumerate(names):
        wanted = [j for j in range(len(stats)) if (i, j) in by_count]
        if not wanted:
            continue
        counts = df.groupBy(*groups, col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        v = F.unix_micros(F.col("__v").cast("timestamp")) if isinstance(kinds[c], TEMPORAL) else F.col("__v").cast("double")
        middle = F.percentile(v, 0.5, F.col("__c"))
        middle = F.timestamp_micros(middle.cast("bigint")).cast("timestamp_ntz") if isinstance(kinds[c], TEMPORAL) else middle
        found = counts.groupBy(*groups).agg(*[(F.count("__v").cast("int") if stats[j] == "countUnique" else middle).alias(f"__{i}_{j}") for j in wanted])
        keys = [f"__k{n}" for n in range(len(cats))]
        found = found.select(*[col(k).alias(n) for k, n in zip(cats, keys, strict=True)], *[f"__{i}_{j}" for j in wanted])
        # the same groups on both sides; without categories both have one row
        same = [col(k).eqNullSafe(F.col(n)) for k, n in zip(cats, keys, strict=True)] or [F.lit(True)]
        out = out.join(found, same, "inner").drop(*keys)
    return out


def numeric_columns(df: DataFrame, without: list[str]) -> list[str]:
    return [c for c in visible(df) if is_numeric(df.schema[c].dataType) and c not in without]


def _pairs(df: DataFrame, x: str | None, y: str | None, cats: list[str], both_ways: bool) -> list[tuple[str, str]]:
    if x and y:
        return [(x, y)]
    names = numeric_columns(df, cats)
    if x or y:
        return [(x, c) if x else (c, y) for c in names if c not in (x, y)]
    return list(permutations(names, 2) if both_ways else combinations(names, 2))


def _long(wide: DataFrame, cats: list[str], pairs: list[tuple[str, str]], outputs: list[str], decimals: int | None) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), *[rounded(F.col(f"__{i}_{o}"), decimals).alias(o) for o in outputs]) for i, (a, b) in enumerate(pairs)])
    return wide.select(*[col(c) for c in cats], F.explode(rows).alias("__r")).select(*[col(c) for c in cats], "__r.*").orderBy(*[col(c).asc_nulls_last() for c in cats], "x", "y")


def _both(a: str, b: str) -> tuple[Column, Column]:
    """The two columns on rows where neither is null."""
    ok = col(a).isNotNull() & col(b).isNotNull()
    return F.when(ok, col(a).cast("double")), F.when(ok, col(b).cast("double"))


def correlations(df: DataFrame, x: str | None = None, y: str | None = None, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Pearson's coefficient of all pairs of numeric columns, of x with all, or of one pair; NaN where a column is constant."""
    cats = listed(categories)
    pairs = _pairs(df, x, y, cats, both_ways=False)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        u, v = _both(a, b)
        flat = (F.var_pop(u) == 0) | (F.var_pop(v) == 0)
        aggs.append(F.when(F.count(u) == 0, F.lit(None).cast("double")).when(flat, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))).alias(f"__{i}_corr"))
    return _long(df.groupBy(*[col(c) for c in cats]).agg(*aggs), cats, pairs, ["corr"], decimals)


def linear_regressions(df: DataFrame, x: str | None = None, y: str | None = None, categories: str | list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """Least squares of y on x for all ordered pairs of numeric columns, of x with all, or of one pair."""
    cats = listed(categories)
    pairs = _pairs(df, x, y, cats, both_ways=True)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        u, v = _both(a, b)
        none, nan = F.lit(None).cast("double"), F.lit(float("nan"))
        sxx, syy, sxy = F.var_pop(u), F.var_pop(v), F.covar_pop(u, v)
        slope = F.when(F.count(u) == 0, none).when(sxx == 0, nan).otherwise(F.try_divide(sxy, sxx))
        aggs += [
            slope.alias(f"__{i}_slope"), (F.avg(v) - slope * F.avg(u)).alias(f"__{i}_yIntercept"),
            F.when((F.count(u) == 0) | (sxx == 0), none).when(syy == 0, F.lit(1.0)).otherwise(F.try_divide(sxy * sxy, sxx * syy)).alias(f"__{i}_r2"),
        ]
    return _long(df.groupBy(*[col(c) for c in cats]).agg(*aggs), cats, pairs, ["slope", "yIntercept", "r2"], decimals)


def cube(df: DataFrame, categories: list[str], aggregates: dict[str, str], how: str = "cube") -> DataFrame:
    """Grouping sets: ``cube`` or ``rollup`` with {new name: SQL aggregate}."""
    grouped = getattr(df, how)(*[col(c) for c in categories])
    return grouped.agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
