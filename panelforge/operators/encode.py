"""Row-wise recoding: binary, ordinal and nominal encodings, row reducers, coalesced families."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import numeric, quoted

REDUCERS = ("sum", "mean", "median", "min", "max", "coalesce")


@dataclass(frozen=True)
class ColumnRole:
    """What a wide panel's column name says: ``{root}_w{wave}`` or ``non_long__w{wave}__{root}``."""

    name: str
    root: str
    wave: int | None
    static: bool


def column_role(name: str) -> ColumnRole:
    if m := re.fullmatch(r"non_long__w(\d+)__(.+)", name, re.I):
        return ColumnRole(name, m[2], int(m[1]), True)
    if m := re.fullmatch(r"(.+)_w(\d+)", name, re.I):
        return ColumnRole(name, m[1], int(m[2]), False)
    return ColumnRole(name, name, None, True)


def reduce_row(df: DataFrame, inputs: Sequence[str], how: str) -> Column:
    """One value of several columns: sum (null if all are null), mean, median, min, max of the numbers among them, or
    the first that is not null. NaN counts as null; the median of an even number is the midpoint."""
    if how not in REDUCERS:
        raise InputValidationError(f"reducer must be one of {REDUCERS}")
    if how == "coalesce":
        return F.coalesce(*(F.when(~F.isnan(quoted(c)), F.col(quoted(c))) if dict(df.dtypes)[c] in ("double", "float") else F.col(quoted(c)) for c in inputs))
    there = F.array_compact(F.array(*(numeric(df, c) for c in inputs)))
    n = F.size(there)
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        return F.when(n > 0, total)
    if how == "mean":
        return F.when(n > 0, total / n)
    if how == "min":
        return F.array_min(there)
    if how == "max":
        return F.array_max(there)
    ordered = F.array_sort(there)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, mid)).when(n > 0, (F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2)


def coalesce_family(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each canonical column as the first non-null of itself (if there) and its sources, in order; sources are dropped."""
    drop = {c for x in families.values() for c in x} - set(families)
    keep = [F.col(quoted(c)) for c in df.columns if c not in drop and c not in families]
    made = [F.coalesce(*(F.col(quoted(c)) for c in ([name] if name in df.columns else []) + [c for c in sources if c != name])).alias(name) for name, sources in families.items()]
    return df.select(*keep, *made)


def binary(df: DataFrame, column: str, mapping: Mapping[float, float]) -> Column:
    """0/1 (or other numbers) for the mapped codes, null for all others."""
    value, out = numeric(df, column), None
    for code, to in mapping.items():
        out = F.when(value == float(code), float(to)) if out is None else out.when(value == float(code), float(to))
    if out is None:
        raise InputValidationError("the mapping is empty")
    return out.cast("double")


def ordinal(df: DataFrame, column: str, ordered: Sequence[float] | None = None) -> Column:
    """The number itself, or its place from 1 among ``ordered``; null for values that are not listed."""
    value = numeric(df, column)
    if ordered is None:
        return value
    place = F.array_position(F.array(*(F.lit(float(x)) for x in ordered)), value)
    return F.when(place > 0, place.cast("double"))


def code_text(code: float) -> str:
    return str(int(code)) if float(code).is_integer() else str(code).replace(".", "p")


def one_hot_name(column: str, code: float) -> str:
    role = column_role(column)
    if role.static and role.wave is not None:
        return f"non_long__w{role.wave}__{role.root}__v{code_text(code)}"
    return f"{role.root}__v{code_text(code)}_w{role.wave}" if role.wave is not None else f"{role.root}__v{code_text(code)}"


def one_hot(df: DataFrame, columns: Mapping[str, Sequence[float]]) -> DataFrame:
    """A 0/1 column for each configured code, in place of its source; null where the source is null."""
    made: list[tuple[str, Column]] = []
    for column, codes in columns.items():
        value = numeric(df, column)
        made += [(one_hot_name(column, x), F.when(value.isNotNull(), (value == float(x)).cast("double"))) for x in codes]
    names = [n for n, _ in made]
    keep = [c for c in df.columns if c not in columns]
    clash = sorted(set(n for n in names if names.count(n) > 1) | set(names) & set(keep))
    if clash:
        raise InputValidationError(f"one-hot names exist already: {', '.join(clash)}")
    return df.select(*(quoted(c) for c in keep), *(c.alias(n) for n, c in made))


def single_wave_names(created: Sequence[str], surviving: Sequence[str]) -> dict[str, str]:
    """New static names for one-hot families ``{root}__v{code}_w{wave}`` of which only one wave survives."""
    waves: dict[str, set[int]] = {}
    alive = [column_role(c) for c in created if c in set(surviving)]
    for role in alive:
        if not role.static:
            waves.setdefault(role.root.rsplit("__v", 1)[0], set()).add(role.wave)
    return {r.name: f"non_long__w{r.wave}__{r.root}" for r in alive if not r.static and len(waves[r.root.rsplit("__v", 1)[0]]) == 1}


def require_policy(columns: Sequence[str], roots: Sequence[str]) -> None:
    """Every column's root must have a policy (compared without case)."""
    known = {r.lower() for r in roots}
    unknown = sorted({column_role(c).root for c in columns if column_role(c).root.lower() not in known})
    if unknown:
        raise InputValidationError(f"no encoding policy for {', '.join(unknown[:12])}")
