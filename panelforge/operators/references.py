"""References to records that do not exist (problem 3).

Composite keys may hold nulls in some parts. References are grouped by the mask of their null parts; each mask is
matched on its non-null columns only, under the declared match semantics of the SQL standard:

* ``simple``: a reference with any null part refers to nothing;
* ``full``: all parts null refers to nothing, some parts null is an orphan;
* ``partial``: the non-null parts must occur together in some target.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import quoted, splittable_join

MATCHES = ("simple", "full", "partial")


def check_references(
    refs: DataFrame,
    ref_cols: list[str],
    targets: DataFrame,
    key_cols: list[str],
    *,
    match: str = "simple",
    at: str | None = None,
    since: str | None = None,
    until: str | None = None,
    cause: str = "cause",
) -> DataFrame:
    """``refs`` with a column ``cause``, one row per reference.

    ``cause`` is ``none`` for a matched reference, ``absent`` where the row refers to nothing, ``missing`` without a
    target, ``deleted`` where the target ended (``until``) at or before ``at``, ``late`` where it began (``since``)
    after ``at``. Several target rows of one key count as one target that begins with the earliest and ends, if all
    have ended, with the latest. A null ``at``, ``since`` or ``until`` makes no case. Targets with a null key part are
    no targets of a full match; for ``partial`` they match on their non-null parts. Extra columns of ``refs`` stay;
    those of ``targets`` are not read, so equal names cannot clash. An empty ``targets`` makes every reference an orphan.

    The target side is reduced to one row per key before the join, so the join never multiplies rows; a hot reference
    key is split by the adaptive skew join (:func:`splittable_join`).
    """
    if match not in MATCHES:
        raise InputValidationError(f"match must be one of {MATCHES}")
    if len(ref_cols) != len(key_cols) or not ref_cols or len(ref_cols) > 6:
        raise InputValidationError("as many reference columns as key columns, one to six, are needed")
    if cause in refs.columns:
        raise InputValidationError(f"column {cause!r} exists already")
    k = len(ref_cols)
    keys = [f"__key{i}" for i in range(k)]
    target = targets.select(
        *(F.col(quoted(c)).alias(a) for c, a in zip(key_cols, keys)),
        (F.col(quoted(since)) if since else F.lit(None).cast("timestamp")).alias("__since"),
        (F.col(quoted(until)) if until else F.lit(None).cast("timestamp")).alias("__until"),
    )
    null = [F.col(quoted(c)).isNull() for c in ref_cols]
    some, every = reduce(Column.__or__, null), reduce(Column.__and__, null)
    if match == "simple":
        parts = [refs.filter(some).withColumn(cause, F.lit("absent"))]
        masks = [(False,) * k]
    elif match == "full":
        parts = [refs.filter(some).withColumn(cause, F.when(every, "absent").otherwise("missing"))]
        masks = [(False,) * k]
    else:
        parts = [refs.filter(every).withColumn(cause, F.lit("absent"))]
        masks = [m for m in product((False, True), repeat=k) if not all(m)]
    for mask in masks:
        own = refs.filter(reduce(Column.__and__, [c if m else ~c for c, m in zip(null, mask)]))
        on = [(quoted(r), a) for r, a, m in zip(ref_cols, keys, mask) if not m]
        there = _one_per_key(target, [a for _, a in on])
        copies = own.select("*", *(F.col(r).alias(a) for r, a in on))
        joined = splittable_join(copies, there, [a for _, a in on], "left")
        parts.append(joined.withColumn(cause, _cause(at)).drop(*keys, "__there", "__first", "__end"))
    return reduce(DataFrame.unionByName, parts)


def _one_per_key(target: DataFrame, keys: list[str]) -> DataFrame:
    there = target.filter(reduce(Column.__and__, [F.col(a).isNotNull() for a in keys]))
    return there.groupBy(*keys).agg(
        F.lit(True).alias("__there"),
        F.min("__since").alias("__first"),
        F.when(F.count("__until") == F.count(F.lit(1)), F.max("__until")).alias("__end"),
    )


def _cause(at: str | None) -> Column:
    out = F.when(F.col("__there").isNull(), "missing")
    if at:
        t = F.col(quoted(at))
        out = out.when(F.col("__end") <= t, "deleted").when(F.col("__first") > t, "late")
    return out.otherwise("none")


def orphans(*args, **kwargs) -> DataFrame:
    """Only the references with a cause ``missing``, ``deleted`` or ``late`` of :func:`check_references`."""
    return check_references(*args, **kwargs).filter(F.col(kwargs.get("cause", "cause")).isin("missing", "deleted", "late"))


def reference_report(checked: DataFrame, by: list[str], cause: str = "cause") -> DataFrame:
    """Matched and unmatched rows of :func:`check_references` per ``by`` (table, reference, period)."""
    count = lambda *causes: F.count_if(F.col(cause).isin(*causes))
    return checked.groupBy(*by).agg(
        count("none").alias("matched_rows"),
        count("missing", "deleted", "late").alias("unmatched_rows"),
        count("missing").alias("missing_rows"),
        count("deleted").alias("deleted_rows"),
        count("late").alias("late_rows"),
        count("absent").alias("without_reference"),
    )
