"""Column expressions with the engine's rules for nulls, division, rounding and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def listed(x: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """A name or names as a list."""
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def divide(a: Column, b: Column) -> Column:
    """Floating division that gives infinities and NaN instead of an error; null in, null out."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def rounded(x: Column, decimals: int | None) -> Column:
    """Half away from zero on the binary value (1.005 to two digits is 1.0)."""
    if decimals is None:
        return x
    scale = F.lit(float(10**decimals))
    plain = F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double") / scale
    # beyond 2**52 a double has no fraction to round; infinities and NaN stay
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) * scale >= F.lit(2.0**52)), x).otherwise(plain)


def ascending(name: str) -> Column:
    return col(name).asc_nulls_last()


def descending(name: str) -> Column:
    return col(name).desc_nulls_last()


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def sample_skewness(x: Column) -> Column:
    """Sample-adjusted skewness; null for fewer than three values."""
    n = F.count(x).cast("double")
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, adjusted)
