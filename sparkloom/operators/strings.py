"""Texts and numbers, row by row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import col, listed, rounded
from sparkloom.operators.columns import need
from sparkloom.operators.order import in_order, visible


def each(df: DataFrame, columns: str | list[str], make) -> DataFrame:
    need(df, listed(columns))
    return df.withColumns({c: make(col(c)) for c in listed(columns)})


def trim(df: DataFrame, columns: str | list[str], character: str | None = None, method: str = "trim") -> DataFrame:
    """``character`` is a set of characters to take off; blanks without it."""
    f = {"trim": F.trim, "leftTrim": F.ltrim, "rightTrim": F.rtrim}[method]
    return each(df, columns, lambda c: f(c, F.lit(character)) if character else f(c))


def lower(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return each(df, columns, F.lower)


def upper(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return each(df, columns, F.upper)


def capitalize(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """First letter upper, all others lower; null becomes an empty text."""
    return each(df, columns, lambda c: F.coalesce(F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1))), F.lit("")))


def left(df: DataFrame, columns: str | list[str], n: int) -> DataFrame:
    return each(df, columns, lambda c: F.left(c, F.lit(n)))


def right(df: DataFrame, columns: str | list[str], n: int) -> DataFrame:
    return each(df, columns, lambda c: F.right(c, F.lit(n)))


def pad(df: DataFrame, columns: str | list[str], length: int, method: str = "left", char: str = "0") -> DataFrame:
    """Fills texts up to a length; a longer text is an error."""
    names = listed(columns)
    need(df, names)
    for c in names:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"{c} is not a text")
    longest = df.agg(*[F.max(F.length(col(c))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    for i, c in enumerate(names):
        if (longest[i] or 0) > length:
            raise ValueError(f"{c} has texts of {longest[i]} characters, more than {length}")
    f = F.lpad if method == "left" else F.rpad
    return each(df, names, lambda c: f(c, length, char))


def replace(df: DataFrame, columns: str | list[str], pairs: dict[str, str], entire: bool = False, regex: bool = False) -> DataFrame:
    """Pairs are applied one after another; ``entire`` replaces whole values, ``regex`` takes patterns with \\1 groups."""
    if entire and regex:
        raise ValueError("entire and regex exclude each other")
    names = [c for c in visible(df) if isinstance(df.schema[c].dataType, T.StringType)] if columns == "all" else listed(columns)

    def make(c: Column) -> Column:
        for old, new in pairs.items():
            if entire:
                c = F.when(c == old, F.lit(new)).otherwise(c)
            elif regex:
                c = F.regexp_replace(c, F.lit(old), F.lit(re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$"))))
            else:
                c = F.replace(c, F.lit(old), F.lit(new))
        return c

    return each(df, names, make)


def replace_nulls(df: DataFrame, columns: str | list[str], value: object) -> DataFrame:
    names = visible(df) if columns == "all" else listed(columns)
    need(df, names)
    return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(df.schema[c].dataType)) for c in names})


def concatenate(df: DataFrame, columns: list[str], new: str, separator: str | None = None) -> DataFrame:
    """Nulls are left out."""
    need(df, columns)
    return df.withColumn(new, F.concat_ws(separator or "", *[col(c).cast("string") for c in columns]))


def concatenate_row(df: DataFrame, columns: list[str], new: str) -> DataFrame:
    """Blocks of a column's name and its text on the next line; null is Unknown."""
    need(df, columns)
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"{c} is not a text")
    return df.withColumn(new, F.concat_ws("\n\n", *[F.concat(F.lit(f"{c}:\n"), F.coalesce(col(c), F.lit("Unknown"))) for c in columns]))


def split_extract(df: DataFrame, column: str, separator: str, index: int, new: str) -> DataFrame:
    """The part of this number from 0; an empty text where there is none."""
    need(df, [column])
    return df.withColumn(new, F.split_part(col(column), F.lit(separator), F.lit(index + 1)))


def split_spread(df: DataFrame, column: str, separator: str, new: list[str], no_check: bool = False) -> DataFrame:
    """Parts go to as many columns; more parts than columns is an error unless ``no_check``."""
    need(df, [column])
    if not no_check:
        many = df.where(F.size(F.split(col(column), re.escape(separator))) > len(new))
        bad = in_order(many).select(col(column)).limit(5).collect()
        if bad:
            raise ValueError(f"more than {len(new)} parts, e.g. in {[r[0] for r in bad]}")
    return df.withColumns({n: F.split_part(col(column), F.lit(separator), F.lit(i + 1)) for i, n in enumerate(new)})


_ACCENTED = "ÀÁÂÃÄÅàáâãäåĀāĂăĄąÇçĆćĈĉĊċČčĎďÈÉÊËèéêëĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥÌÍÎÏìíîïĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľÑñŃńŅņŇňÒÓÔÕÖòóôõöŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťÙÚÛÜùúûüŨũŪūŬŭŮůŰűŲųŴŵÝýÿŶŷŸŹźŻżŽž"
_PLAIN = "AAAAAAaaaaaaAaAaAaCcCcCcCcCcDdEEEEeeeeEeEeEeEeEeGgGgGgGgHhIIIIiiiiIiIiIiIiIJjKkLlLlLlNnNnNnNnOOOOOoooooOoOoOoRrRrRrSsSsSsSsTtTtUUUUuuuuUuUuUuUuUuUuWwYyyYyYZzZzZz"


def unaccented(c: Column) -> Column:
    """Latin letters without their accents, on the JVM; combining marks go."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def normalize_string(df: DataFrame, column: str, new: str, strip_punctuation: bool = True) -> DataFrame:
    """No accents, lower case, no punctuation, single blanks."""
    need(df, [column])
    c = F.lower(unaccented(col(column)))
    if strip_punctuation:
        c = F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")
    return df.withColumn(new, F.trim(F.regexp_replace(c, r"\s+", " ")))


def round_columns(df: DataFrame, columns: str | list[str], decimals: int = 0, method: str = "round") -> DataFrame:
    """``ceiling`` and ``floor`` go to whole numbers whatever ``decimals`` is."""
    need(df, listed(columns))

    def make(name: str) -> Column:
        c, kind = col(name), df.schema[name].dataType
        if method == "round":
            return rounded(c.cast("double"), decimals).cast(kind)
        return (F.ceil(c) if method == "ceiling" else F.floor(c)).cast(kind)

    return df.withColumns({c: make(c) for c in listed(columns)})
