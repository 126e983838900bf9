"""Keyed joins with checked cardinality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import quoted
from panelforge.operators.project import require_columns
from panelforge.operators.reshape import keep_first


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key occurs twice (null parts count as values)."""
    twice = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if twice:
        raise InputValidationError(f"{what} has repeated keys {tuple(keys)}")


def combine_with_trajectories(data: DataFrame, trajectories: DataFrame, data_id: str, trajectory_id: str, *, columns: Sequence[str] = (), drop: Sequence[str] = (), how: str = "left", order: Sequence[str] = ()) -> DataFrame:
    """``data`` with the columns of its subject's trajectory row.

    The right side loses null ids and keeps one row per id, the first in ``order`` (default: all its columns). Names
    that clash get the suffix ``_trajectory``; the right key goes if it is named otherwise. ``drop`` columns leave the
    result. Ids of different types are compared as text without outer blanks.
    """
    if how not in ("left", "inner"):
        raise InputValidationError("how must be left or inner")
    require_columns(data, [data_id])
    wanted = list(columns) or [c for c in trajectories.columns if c != trajectory_id]
    require_columns(trajectories, [trajectory_id, *wanted, *order])
    right = keep_first(trajectories.filter(F.col(quoted(trajectory_id)).isNotNull()), [trajectory_id], list(order) or sorted(trajectories.columns))
    names = {c: c + "_trajectory" if c in data.columns else c for c in wanted if c != trajectory_id}
    if trajectory_id not in data.columns and trajectory_id in wanted:
        names[trajectory_id] = trajectory_id
    taken = set(data.columns)
    for c, n in names.items():
        if n in taken:
            raise InputValidationError(f"column {n!r} would exist twice")
        taken.add(n)
    right = right.select(F.col(quoted(trajectory_id)).alias("__id"), *(F.col(quoted(c)).alias(n) for c, n in names.items()))
    same = data.schema[data_id].dataType == trajectories.schema[trajectory_id].dataType
    left_id, right_id = data[quoted(data_id)], F.col("__id")
    on = left_id == right_id if same else F.trim(left_id.cast("string")) == F.trim(right_id.cast("string"))
    out = data.join(right, on, how).drop("__id")
    require_columns(out, drop)
    return out.drop(*drop)


def unmatched_rows(combined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows of which all trajectory ``columns`` are null, and all rows."""
    none = reduce(Column.__and__, [F.col(quoted(c)).isNull() for c in columns])
    return combined.agg(F.count_if(none).alias("unmatched_rows"), F.count(F.lit(1)).alias("n_rows"))


def join_roles(anchor: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], str]], *, validate: bool = True) -> DataFrame:
    """``anchor`` left-joined with each (table, keys, name), whose keys must be unique: rows never multiply."""
    out = anchor
    for table, keys, name in tables:
        if validate:
            assert_unique(table.dropna(subset=list(keys)), keys, name)
        clash = set(table.columns) & set(out.columns) - set(keys)
        if clash:
            raise InputValidationError(f"columns of {name} exist already: {', '.join(sorted(clash))}")
        out = out.join(table.dropna(subset=list(keys)), list(keys), "left")
    return out


def coverage(anchor: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys of ``anchor``, and those of them that ``table`` has."""
    a = anchor.select(*map(quoted, keys)).dropna().distinct()
    b = table.select(*map(quoted, keys)).dropna().distinct().withColumn("__hit", F.lit(1))
    return a.join(b, list(keys), "left").agg(F.count(F.lit(1)).alias("anchor_rows"), F.count("__hit").alias("matched_rows"))


def complete_labels(assignments: DataFrame, all_ids: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Every id, with null labels where it has no assignment."""
    return all_ids.select(quoted(subject)).distinct().join(assignments, subject, "left")
