"""Pivots, unpivots, unions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import numeric, quoted
from panelforge.operators.aggregate import duplicate_rows, varying_columns
from panelforge.operators.project import require_columns

MAX_TIMES = 10_000


def time_token(value) -> str:
    """A time value in a column name: 3 -> ``3``, 1.5 -> ``1p5``, null -> ``missing``, blanks -> ``_``."""
    if value is None:
        return "missing"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "is_integer"):
        return str(int(value)) if float(value).is_integer() else str(float(value)).replace(".", "p")
    return re.sub(r"\s+", "_", str(value).strip())


def resolve_roles(columns: Sequence[str], keys: Sequence[str], longitudinal: Sequence[str], static: Sequence[str]) -> tuple[list[str], list[str]]:
    """Longitudinal and static columns: with neither given all are longitudinal, with one given the rest is the other."""
    rest = [c for c in columns if c not in keys]
    if set(longitudinal) & set(static) or (set(longitudinal) | set(static)) & set(keys):
        raise InputValidationError("a column has two roles")
    if not longitudinal and not static:
        return rest, []
    long = list(longitudinal) or [c for c in rest if c not in static]
    fixed = list(static) or [c for c in rest if c not in longitudinal]
    return long, fixed


def pivot_long_to_wide(df: DataFrame, ids: Sequence[str], time: str, *, longitudinal: Sequence[str] = (), static: Sequence[str] = (), time_label: str = "t", separator: str = "_", times: Sequence | None = None, validate: bool = True) -> DataFrame:
    """One row per ``ids`` with ``{feature}{sep}{label}{token}`` columns, times first, then features.

    One conditional aggregation, so one shuffle. Null ids or times, (ids, time) that are not unique and static columns
    that vary within ids are errors (``validate=False`` skips these three checks, each one job; repeated cells then
    keep the greatest). ``times`` spares the job that lists the distinct times.
    """
    if separator not in ("_", "-") or not re.fullmatch(r"[a-z][a-z0-9]{0,15}", time_label):
        raise InputValidationError("separator must be _ or -, the label a short lower-case word")
    require_columns(df, [*ids, time, *longitudinal, *static])
    long, fixed = resolve_roles(df.columns, [*ids, time], longitudinal, static)
    if validate:
        bad = df.filter(reduce(Column.__or__, [F.col(quoted(c)).isNull() for c in [*ids, time]])).limit(1).count()
        if bad:
            raise InputValidationError("ids and time must not be null")
        twice = duplicate_rows(df, [*ids, time]).first()["duplicate_rows"]
        if twice:
            raise InputValidationError(f"{twice} rows share their ids and time with another row")
        if fixed:
            varying = [r["column_name"] for r in varying_columns(df, ids, fixed).filter("groups_varying > 0").collect()]
            if varying:
                raise InputValidationError(f"static columns vary within ids: {', '.join(varying)}")
    if times is None:
        times = [r[0] for r in df.select(quoted(time)).distinct().orderBy(quoted(time)).limit(MAX_TIMES + 1).collect()]
        if len(times) > MAX_TIMES:
            raise InputValidationError("too many times for a wide table")
    t = F.col(quoted(time))
    made = [F.max(quoted(c)).alias(c) for c in fixed]
    names = set(ids) | set(fixed)
    for v in times:
        for c in long:
            name = f"{c}{separator}{time_label}{time_token(v)}"
            if name in names:
                raise InputValidationError(f"column {name!r} would exist twice")
            names.add(name)
            made.append(F.max(F.when(t.eqNullSafe(F.lit(v)), F.col(quoted(c)))).alias(name))
    return df.groupBy(*map(quoted, ids)).agg(*made)


def unpivot_wide(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Mapping[float, str]], time: str = "wave") -> DataFrame:
    """The inverse: a row per id and time with one column per feature; ``groups`` maps feature -> time -> column.

    A feature without a column at a time is null there; rows whose features are all null are left out.
    """
    steps = sorted({t for g in groups.values() for t in g})
    cells = F.array(*(F.struct(F.lit(t).alias(time), *((F.col(quoted(g[t])) if t in g else F.lit(None)).cast("double").alias(n) for n, g in groups.items())) for t in steps))
    out = df.select(*map(quoted, ids), F.explode(cells).alias("x")).select(*map(quoted, ids), "x.*")
    return out.filter(reduce(Column.__or__, [F.col(quoted(n)).isNotNull() for n in groups]))


def feature_groups(columns: Sequence[str], suffix: str) -> dict[str, dict[int, str]]:
    """Columns that end in ``{suffix}{number}``, grouped by what stands before; groups of two waves or more."""
    groups: dict[str, dict[int, str]] = {}
    for c in columns:
        if m := re.fullmatch(rf"(.+?){re.escape(suffix)}(\d+)", c):
            groups.setdefault(m[1], {})[int(m[2])] = c
    return {k: dict(sorted(v.items())) for k, v in groups.items() if len(v) > 1}


def pivot_slots(df: DataFrame, keys: Sequence[str], slot: Column, slots: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``{slot}__{value}`` columns with the first non-null value (in ``order``) of each slot; rows without slot count for none."""
    rows = df.withColumn("__slot", slot)
    o = F.struct(*(F.col(quoted(c)) for c in order))
    made = [F.min_by(quoted(v), F.when((F.col("__slot") == s) & F.col(quoted(v)).isNotNull(), o)).alias(f"{s}__{v}") for s in slots for v in values]
    return rows.groupBy(*map(quoted, keys)).agg(*made)


def waves_to_wide(df: DataFrame, subject: str, wave: str, waves: Sequence, canonical: Sequence[str], static: Sequence[str]) -> DataFrame:
    """One row per subject: the first non-null (by wave) of static columns, canonical columns as ``{name}_w{number}``."""
    w = F.col(quoted(wave))
    number = F.regexp_extract(w.cast("string"), r"(\d+)", 1).try_cast("int")
    made = [F.min_by(quoted(c), F.when(F.col(quoted(c)).isNotNull(), F.struct(number, F.col(quoted(c))))).alias(c) for c in static]
    for c in sorted(canonical):
        for v in waves:
            digits = re.search(r"(\d+)", str(v))
            made.append(F.min(F.when(w == F.lit(v), F.col(quoted(c)))).alias(f"{c}_w{digits[1] if digits else v}"))
    return df.groupBy(quoted(subject)).agg(*made)


def sort_long(df: DataFrame, subject: str, wave: str) -> DataFrame:
    """By subject, then by the number in the wave's name, then by the name."""
    number = F.regexp_extract(F.col(quoted(wave)).cast("string"), r"(\d+)", 1).try_cast("int")
    return df.orderBy(quoted(subject), number.asc_nulls_last(), F.col(quoted(wave)).asc_nulls_last())


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under all columns, missing ones null."""
    if not frames:
        raise InputValidationError("there is nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys without nulls of all frames."""
    return reduce(DataFrame.union, [f.select(*map(quoted, keys)) for f in frames]).dropna().distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order`` (nulls last)."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*(F.col(quoted(c)).asc_nulls_last() for c in order))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def long_to_series(df: DataFrame, subject: str, time: str, values: Sequence[str]) -> DataFrame:
    """(subject_id, times, series): each subject's values as arrays in the order of time. Repeated rows of a time are
    averaged first, so a list is as long as the subject has times; null times are left out."""
    rows = df.select(F.col(quoted(subject)).alias("subject_id"), numeric(df, time).alias("t"), *(numeric(df, v).alias(f"v{i}") for i, v in enumerate(values))).filter("t IS NOT NULL")
    cells = rows.groupBy("subject_id", "t").agg(F.array(*(F.avg(f"v{i}") for i in range(len(values)))).alias("v"))
    out = cells.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("rows"))
    return out.select("subject_id", F.col("rows.t").alias("times"), F.col("rows.v").alias("series"))
