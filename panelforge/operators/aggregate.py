"""Grouped aggregation of long panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import NUMERIC, not_nan, numeric, quoted
from panelforge.operators.project import numeric_columns, require_columns
from panelforge.operators.ranks import exact_quantiles

NUMERIC_AGGREGATES = ("mean", "median", "min", "max", "std")
CATEGORICAL_AGGREGATES = ("mode", "first", "last")


def _numeric_aggregate(c: Column, how: str) -> Column:
    return {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp}[how](c)


def aggregate_to_cross_section(df: DataFrame, subject: str, *, numeric_cols: Sequence[str] | None = None, categorical_cols: Sequence[str] = (), numeric_agg: str = "mean", categorical_agg: str = "mode", order: str | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """One row per subject (null is a subject of its own).

    Numeric columns, all if none are named, by mean, median, min, max or standard deviation (null for one value); NaN
    counts as null. Categorical columns by mode (ties: the least), or the first or last non-null in the order of the
    column ``order``, which these two need since rows have no order of their own. Medians and modes hold a group's
    distinct values in memory, so subjects of over ``hot_rows`` rows are aggregated apart, from counts per value.
    """
    if numeric_agg not in NUMERIC_AGGREGATES or categorical_agg not in CATEGORICAL_AGGREGATES:
        raise InputValidationError("unknown aggregate")
    numbers = list(numeric_cols) if numeric_cols is not None else numeric_columns(df, [subject, *categorical_cols])
    require_columns(df, [subject, *numbers, *categorical_cols])
    if set(numbers) & set(categorical_cols) or subject in [*numbers, *categorical_cols]:
        raise InputValidationError("a column has two roles")
    if categorical_agg != "mode" and categorical_cols and not order:
        raise InputValidationError("first and last need an order column")
    if not numbers and not categorical_cols:
        raise InputValidationError("there is no column to aggregate")
    for c in numbers:
        if not isinstance(df.schema[c].dataType, NUMERIC):
            raise InputValidationError(f"{c!r} is not numeric")
    plain = {c: _numeric_aggregate(not_nan(F.col(quoted(c)), df.schema[c].dataType), numeric_agg) for c in numbers}
    for c in categorical_cols:
        v = F.col(quoted(c))
        if categorical_agg == "mode":
            plain[c] = F.mode(v, True)
        else:
            pick = F.min_by if categorical_agg == "first" else F.max_by
            plain[c] = pick(v, F.when(v.isNotNull(), F.struct(F.col(quoted(order)), v)))
    counted = {c for c in numbers if numeric_agg == "median"} | {c for c in categorical_cols if categorical_agg == "mode"}
    simple = df.groupBy(quoted(subject)).agg(*(x.alias(c) for c, x in plain.items()))
    if not counted:
        return simple
    hot = cut(df.groupBy(F.col(quoted(subject)).alias("__s")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select("__s"))
    if hot.isEmpty():
        return simple
    same = F.col(quoted(subject)).eqNullSafe(F.col("__s"))
    cool = df.join(hot, same, "left_anti").groupBy(quoted(subject)).agg(*(x.alias(c) for c, x in plain.items()))
    rows = df.join(hot, same, "left_semi")
    out = rows.groupBy(F.col(quoted(subject)).alias("__s0")).agg(F.lit(1).alias("__one"), *(x.alias(c) for c, x in plain.items() if c not in counted))
    for i, c in enumerate(plain):
        if c not in counted:
            continue
        value = not_nan(F.col(quoted(c)), df.schema[c].dataType)
        counts = rows.select(F.col(quoted(subject)).alias("s"), (value.cast("double") if c in numbers else value).alias("v")).filter("v IS NOT NULL").groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
        if c in numbers:
            best = exact_quantiles(counts, ["s"], "v", "n", [0.5]).withColumnRenamed("q0", c)
        else:
            best = counts.groupBy("s").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(c))
        best = best.withColumnRenamed("s", f"__s{i + 1}")
        out = out.join(best, F.col("__s0").eqNullSafe(F.col(f"__s{i + 1}")), "left").drop(f"__s{i + 1}")
    out = out.select(F.col("__s0").alias(subject), *(F.col(quoted(c)) for c in plain))
    return cool.unionByName(out)


def varying_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column_name, groups_varying): in how many groups a static column is not one value (null is a value)."""
    per = df.groupBy(*map(quoted, keys)).agg(*((F.coalesce(F.min(quoted(c)) != F.max(quoted(c)), F.lit(False)) | ((F.count(quoted(c)) > 0) & (F.count(quoted(c)) < F.count(F.lit(1))))).alias(f"v{i}") for i, c in enumerate(columns)))
    out = per.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(f"v{i}").alias("groups_varying")) for i, c in enumerate(columns))).alias("x"))
    return out.select(F.explode("x").alias("x")).select("x.*")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows share their keys with another row, and how many such keys there are."""
    n = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_keys"))


def complete_subjects(df: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """(subject, is_complete): whether no row of the subject lacks any of ``columns`` (NaN is lacking)."""
    lacks = reduce(Column.__or__, [F.col(quoted(c)).isNull() | (F.isnan(quoted(c)) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False)) for c in columns])
    return df.groupBy(quoted(subject)).agg((~F.bool_or(lacks)).alias("is_complete"))


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: null (or NaN) cells of the whole table, and rows."""
    lacks = [(F.col(quoted(f.name)).isNull() | (F.isnan(quoted(f.name)) if f.dataType.simpleString() in ("double", "float") else F.lit(False))).cast("long") for f in df.schema]
    return df.agg(F.sum(reduce(Column.__add__, lacks)).alias("missing_cells"), F.count(F.lit(1)).alias("n_rows"))


def with_missing_count(df: DataFrame, columns: Sequence[str], name: str = "missing_feature_count") -> DataFrame:
    """Each row's number of null cells among ``columns``."""
    return df.withColumn(name, reduce(Column.__add__, [F.col(quoted(c)).isNull().cast("long") for c in columns]))


def class_time_profile(df: DataFrame, trajectory: str, time: str, value: str) -> DataFrame:
    """Mean, standard deviation (0 for one value), count and standard error per class and time; nulls are left out."""
    v = numeric(df, value)
    rows = df.select(F.col(quoted(trajectory)).alias("trajectory"), F.col(quoted(time)).alias("time"), v.alias("value")).dropna()
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return rows.groupBy("trajectory", "time").agg(F.avg("value").alias("mean"), sd.alias("std"), F.count("value").alias("n"), (sd / F.sqrt(F.count("value"))).alias("sem"))


def class_sizes(df: DataFrame, subject: str, trajectory: str) -> DataFrame:
    """Distinct subjects per class, a subject with several classes counting for the least; and their share."""
    one = df.filter(F.col(quoted(subject)).isNotNull() & F.col(quoted(trajectory)).isNotNull()).groupBy(quoted(subject)).agg(F.min(quoted(trajectory)).alias("trajectory"))
    sizes = one.groupBy("trajectory").agg(F.count(F.lit(1)).alias("n_subjects"))
    return sizes.withColumn("share", F.col("n_subjects") / F.sum("n_subjects").over(Window.partitionBy(F.lit(1))))


def mean_curves(df: DataFrame, subject: str, time: str, values: Sequence[str]) -> DataFrame:
    """One row per (subject, time): the mean of each value, repeated rows averaged, NaN as null."""
    return df.groupBy(quoted(subject), quoted(time)).agg(*(F.avg(numeric(df, v)).alias(v) for v in values))


def growth_statistics(df: DataFrame, subject: str, time: str, value: str) -> DataFrame:
    """Sufficient statistics of a straight line per subject: n, sums of t, t2, y, ty, y2 over complete rows."""
    rows = df.select(F.col(quoted(subject)).alias("subject_id"), numeric(df, time).alias("t"), numeric(df, value).alias("y")).dropna()
    s = lambda e: F.sum(F.expr(e))
    return rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), s("t").alias("st"), s("t * t").alias("stt"), s("y").alias("sy"), s("t * y").alias("sty"), s("y * y").alias("syy"))


def weighted_lines(df: DataFrame, group: str, time: str, value: str, weight: str | None = None) -> DataFrame:
    """Weighted least-squares intercept and slope per group; a group with one time has slope null."""
    w = numeric(df, weight) if weight else F.lit(1.0)
    rows = df.select(F.col(quoted(group)).alias("class"), numeric(df, time).alias("t"), numeric(df, value).alias("y"), w.alias("w")).dropna()
    s = lambda e: F.sum(F.expr(e))
    sums = rows.groupBy("class").agg(s("w").alias("sw"), s("w * t").alias("swt"), s("w * t * t").alias("swtt"), s("w * y").alias("swy"), s("w * t * y").alias("swty"))
    det = F.col("sw") * F.col("swtt") - F.col("swt") * F.col("swt")
    slope = F.when(F.abs(det) > 1e-12, (F.col("sw") * F.col("swty") - F.col("swt") * F.col("swy")) / det)
    return sums.select("class", ((F.col("swy") - slope * F.col("swt")) / F.col("sw")).alias("intercept"), slope.alias("slope"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def sample_per_class(df: DataFrame, subject: str, trajectory: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` subjects of each class, chosen by a hash of the subject and ``seed``: the same at every run."""
    one = df.filter(F.col(quoted(trajectory)).isNotNull() & F.col(quoted(subject)).isNotNull()).select(F.col(quoted(subject)).alias("subject_id"), F.col(quoted(trajectory)).alias("trajectory")).distinct()
    w = Window.partitionBy("trajectory").orderBy(F.xxhash64("subject_id", F.lit(seed)), "subject_id")
    return one.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
