"""Column expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FLOATS = (T.DoubleType, T.FloatType)
NUMERIC = (*FLOATS, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def strip(c: Column) -> Column:
    """Without white space (no-break space too) at either end."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def number(c: Column) -> Column:
    """A text as a double, null where it is no plain decimal number; ``1d`` or ``0x10`` are none."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def not_nan(c: Column, kind: T.DataType | None = None) -> Column:
    """NaN becomes null; other types are returned as they are."""
    return F.when(~F.isnan(c), c) if kind is None or isinstance(kind, FLOATS) else c


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double with null for NaN and for text that is no number."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, NUMERIC):
        return not_nan(c.cast("double"))
    return not_nan(number(c))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_missing(df: DataFrame, name: str, codes: Iterable[float] = ()) -> Column:
    """Null, NaN, or a numeric value among ``codes``, however it is written."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    codes = [float(x) for x in codes]
    if not isinstance(kind, (*NUMERIC, T.StringType, T.BooleanType)):
        return c.isNull()
    value = numeric(df, name)
    base = c.isNull() | (F.isnan(c) if isinstance(kind, FLOATS) else F.lit(False))
    return base | F.coalesce(value.isin(codes), F.lit(False)) if codes else base


def family_key(c: Column) -> Column:
    """A family id without case and outer blanks; null for what stands for no family."""
    key = F.upper(strip(c))
    return F.when(~key.isin("", "NAN", "UNKNOWN", "N/A"), key)


def id_number(c: Column) -> Column:
    """An id as a number however it is spelled; null where it is absent (null, blank, ``NA``)."""
    value = number(c)
    return F.when(value == F.floor(value), value.cast("long"))


def integral_text(c: Column) -> Column:
    """A double as text, without a trailing ``.0``."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def tree(parts: list[Column], op) -> Column:
    """Combine many expressions as a balanced tree, so that deep plans stay shallow."""
    while len(parts) > 1:
        parts = [op(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has this name (without regard to case)."""
    lower = {x.lower() for x in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def splittable_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns whose hot keys the adaptive planner can split, also where a side was grouped by these keys.

    A grouped side keeps its partitioning for a plain join, and the planner leaves such a join whole. A hash of the keys as
    a further key makes both sides meet by a shuffle of their own.
    """
    name = free_name([*left.columns, *right.columns], "__hash")
    key = F.xxhash64(*map(quoted, on)).alias(name)
    return left.select("*", key).join(right.select("*", key), [*on, name], how).drop(name)
