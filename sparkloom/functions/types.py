"""Type names, conversion rules and date patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.exprs import INTEGERS, col

_NAMES = {
    "integer": "int", "int": "int", "float": "double", "number": "double", "double": "double", "string": "string", "varchar": "string", "bigint": "bigint",
    "hugeint": "decimal(38,0)", "date": "date", "time": "time(6)", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "datetimetz": "timestamp",
    "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "boolean": "boolean", "bool": "boolean", "geometry": "binary",
}

_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "j": "DDD", "-d": "d", "-m": "M", "-H": "H", "-I": "h", "-M": "m", "-S": "s", "z": "xx", "Z": "z", "%": "%",
}


def spark_type(name: str) -> str:
    """The Spark type of a user's type name, in any case."""
    key = name.strip().lower()
    if key.startswith("geometry"):
        return "binary"
    if key not in _NAMES:
        raise ValueError(f"unknown type {name!r}")
    return _NAMES[key]


def pattern(fmt: str) -> str:
    """A strftime format as a Java date pattern."""
    out, i, text = [], 0, ""

    def flush() -> None:
        nonlocal text
        if text:
            out.append("".join(c if not c.isalpha() else f"'{c}'" for c in text.replace("'", "''")).replace("''" * 2, "''"))
            text = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            n = 2 if fmt[i + 1] == "-" else 1
            key = fmt[i + 1 : i + 1 + n]
            if key not in _STRFTIME:
                raise ValueError(f"unknown date code %{key}")
            flush()
            out.append(_STRFTIME[key])
            i += 1 + n
        else:
            text += fmt[i]
            i += 1
    flush()
    return "".join(out)


def converted(name: str, have: T.DataType, want: str, *, lenient: bool = False, fmt: str | None = None) -> Column:
    """A column cast to a user's type. ``lenient`` turns what cannot be cast into nulls."""
    x, kind = col(name), spark_type(want)
    text = isinstance(have, T.StringType)
    temporal = isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType))
    number = kind in ("int", "bigint", "double")
    cast = (lambda c, t: c.try_cast(t)) if lenient else (lambda c, t: c.cast(t))
    if fmt is not None and text:
        p = F.lit(pattern(fmt))
        t = F.try_to_timestamp(x, p).cast("timestamp_ntz") if lenient else F.to_timestamp_ntz(x, p)
        # years of two digits from 69 on are of the last century
        return F.when((F.year(t) >= 2069) & F.lit("%y" in fmt), t - F.expr("interval 100 years")).otherwise(t)
    if fmt is not None and temporal and kind == "string":
        return F.date_format(x, pattern(fmt))
    if temporal and number:
        return cast((F.unix_micros(x.cast("timestamp")) / 1000), kind) if kind == "double" else cast(F.unix_millis(x.cast("timestamp")), kind)
    if isinstance(have, T.TimeType) and number:
        return cast(F.time_diff(F.lit("MILLISECOND"), F.lit("00:00:00").cast("time(6)"), x), kind)
    if number and kind != "int" and text:
        x = F.replace(x, F.lit(","), F.lit(""))
    if isinstance(have, (*INTEGERS, T.FloatType, T.DoubleType)) and kind in ("date", "timestamp_ntz"):
        return F.timestamp_millis(x.cast("bigint")).cast("timestamp_ntz")
    if isinstance(have, (*INTEGERS, T.FloatType, T.DoubleType)) and kind.startswith("time("):
        return F.to_time(F.date_format(F.timestamp_millis(x.cast("bigint")), "HH:mm:ss.SSSSSS"), F.lit("HH:mm:ss.SSSSSS"))
    if kind in ("int", "bigint"):
        if isinstance(have, (T.FloatType, T.DoubleType)):
            return cast(F.bround(x), kind)
        if isinstance(have, T.DecimalType):
            return cast(F.round(x), kind)
        if text:
            return cast(F.round(cast(F.trim(x), "decimal(38,9)")), kind)
    if kind == "string" and isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.unix_micros(x.cast("timestamp")) % 1_000_000 == 0, whole).otherwise(F.regexp_replace(F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""))
    return cast(F.trim(x) if text and kind != "string" else x, kind)
