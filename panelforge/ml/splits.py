"""Stratified folds and hold-outs (M3-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.operators.ranks import exact_rank


def parse_split(value: str | float | None) -> float | None:
    """Hold-out share: None for k-fold (``auto``, ``kfold``, ``none``, blank), ``70/30``, a percentage or a share."""
    if value is None:
        return None
    text = str(value).strip().lower()
    if text in ("", "auto", "kfold", "k-fold", "none"):
        return None
    try:
        if "/" in text:
            a, b = (float(x) for x in text.split("/"))
            share = b / (a + b)
        else:
            share = float(text.rstrip("%"))
            share = share / 100 if share > 1 or text.endswith("%") else share
    except (ValueError, ZeroDivisionError):
        raise InputValidationError(f"cannot read the split {value!r}") from None
    if not 0 < share < 1:
        raise InputValidationError("the hold-out share must lie between 0 and 1")
    return share


def with_folds(df: DataFrame, label: str, folds: int, seed: int, *keys: str) -> DataFrame:
    """Column ``fold``: the rows of a class are dealt evenly by their exact rank in the order of a hash of ``keys`` and the
    seed, so fold sizes within a class differ by one at most, and no class is sorted in one task."""
    sizes = [r[1] for r in df.groupBy(label).count().collect()]
    least = min(sizes, default=0)
    if folds < 2 or folds > least:
        raise InputValidationError(f"{folds} folds need as many rows of each class; the smallest class has {least}")
    ranked = exact_rank(df, [label], list(keys), seed=seed, rank="__rank", rows=sum(sizes))
    return ranked.withColumn("fold", F.pmod("__rank", F.lit(folds)).cast("int")).drop("__rank", "group_size")


def with_shuffles(df: DataFrame, label: str, share: float, repeats: int, seed: int, *keys: str) -> DataFrame:
    """Column ``test_in``: the repeats in whose test part a row stands; each class gives its share, rounded, at least one."""
    out = df.withColumn("test_in", F.array().cast("array<int>"))
    rows = df.count()
    for k in range(repeats):
        out = exact_rank(out, [label], list(keys), seed=seed + 1009 * k, rank="__rank", rows=rows)
        inside = F.col("__rank") < F.greatest(F.lit(1), F.round(F.col("group_size") * share))
        out = out.withColumn("test_in", F.when(inside, F.array_append("test_in", F.lit(k))).otherwise(F.col("test_in"))).drop("__rank", "group_size")
    return out
