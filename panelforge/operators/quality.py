"""Column-level quality profile of loads (problem 2).

The table is unpivoted to one row per cell and at once reduced to counts per (load, column, value). The counts are
range-sorted by (column, series, load, value); within each sorted partition, runs of values become segments with local
prefix counts. Adding the totals of the preceding segments gives exact cumulative counts, hence exact quantiles and
distinct counts, and the merged curves of a load and its predecessor give the exact Kolmogorov-Smirnov distance, all
without bringing any column of any load into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import NUMBER, NUMERIC, integral_text, not_nan, quoted, strip

CODE_IN_BRACKETS = r"[\(\[\{]\s*([+-]?\d+(?:\.\d*)?)\s*[\)\]\}]"
SEGMENT_SCHEMA = "column_name string, series long, step long, part int, seq int, n_cur long, n_prev long, n_values long, vals array<double>, cur array<long>, prev array<long>"


def read_codebook(codebook: DataFrame, table: DataFrame) -> list[dict]:
    """The codebook's rows for columns of ``table``, one per column: bounded by the width of the table's schema.

    Columns that the table does not have are left out. Of repeated rows the one that sorts first holds.
    """
    names = [c.lower() for c in table.columns]
    rows = (
        codebook.select("column_name", "kind", not_nan(F.col("low")).alias("low"), not_nan(F.col("high")).alias("high"), "sentinel_codes", "pattern", not_nan(F.col("partial_missing_threshold")).alias("threshold"))
        .withColumn("column_name", F.lower(strip(F.col("column_name"))))
        .filter(F.col("column_name").isin(names))
        .groupBy("column_name")
        .agg(F.min(F.struct("kind", "low", "high", "sentinel_codes", "pattern", "threshold")).alias("x"))
        .select("column_name", "x.*")
        .collect()
    )
    own = {c.lower(): c for c in table.columns}
    out = []
    for r in sorted(rows, key=lambda r: r["column_name"]):
        codes = [float(x) for x in (r["sentinel_codes"] or "").split(",") if x.strip()]
        out.append(r.asDict() | {"column": own[r["column_name"]], "codes": codes})
    return out


def _lookup(codebook: list[dict], field: str, kind: str) -> Column:
    """A codebook field as a literal map from column_name."""
    return F.create_map(*(x for r in codebook for x in (F.lit(r["column_name"]), F.lit(r[field]).cast(kind))))[F.col("column_name")]


def cells(table: DataFrame, codebook: list[dict], keys: list[str]) -> DataFrame:
    """One row per cell: keys, column_name, ``num`` or ``txt`` where valid, and its flags."""
    raw = []
    for r in codebook:
        c, is_number = F.col(quoted(r["column"])), isinstance(table.schema[r["column"]].dataType, NUMERIC)
        raw.append(
            F.struct(
                F.lit(r["column_name"]).alias("column_name"),
                F.lit(is_number).alias("is_number"),
                (c.cast("double") if is_number else F.lit(None).cast("double")).alias("dbl"),
                (F.lit(None).cast("string") if is_number else c.cast("string")).alias("raw"),
            )
        )
    out = table.select(*keys, F.explode(F.array(*raw)).alias("cell")).select(*keys, "cell.*")
    out = out.select("*", strip(F.col("raw")).alias("s"))
    out = out.select("*", F.when(F.col("is_number"), not_nan(F.col("dbl"))).when(F.col("s").rlike(NUMBER), F.col("s").try_cast("double")).alias("value"))
    out = out.select("*", F.regexp_extract("s", CODE_IN_BRACKETS, 1).try_cast("double").alias("code"), _lookup(codebook, "codes", "array<double>").alias("codes"))
    text_missing = F.col("s").isNull() | F.lower("s").isin("", "nan")
    coded = F.coalesce(F.array_contains("codes", F.col("value")), F.lit(False)) | F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False))
    out = out.select("*", (F.when(F.col("is_number"), F.col("value").isNull()).otherwise(text_missing) | coded).alias("missing"))
    outside = F.coalesce(F.col("value") < _lookup(codebook, "low", "double"), F.lit(False)) | F.coalesce(F.col("value") > _lookup(codebook, "high", "double"), F.lit(False))
    violates = F.lit(False)
    for r in codebook:
        if r["pattern"]:
            violates = F.when(F.col("column_name") == r["column_name"], ~F.col("raw").rlike(r["pattern"])).otherwise(violates)
    is_number, valid = F.col("is_number"), ~F.col("missing")
    return out.select(
        *keys,
        "column_name",
        "is_number",
        "missing",
        F.when(valid & is_number, F.col("value")).alias("num"),
        F.when(valid & ~is_number, F.coalesce(integral_text(F.col("value")), F.col("s"))).alias("txt"),
        (valid & outside).alias("out_of_range"),
        (valid & F.coalesce(violates, F.lit(False))).alias("violates"),
    )


def value_counts(table: DataFrame, codebook: list[dict], keys: list[str]) -> DataFrame:
    """Cells reduced to counts per (keys, column, value); partial counts are summed before the shuffle."""
    return cells(table, codebook, keys).groupBy(*keys, "column_name", "is_number", "missing", "num", "txt", "out_of_range", "violates").agg(F.count(F.lit(1)).alias("cnt"))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.ones(len(pdf), bool)
        same = np.ones(len(pdf) - 1, bool)
        for key in ("column_name", "series", "step"):
            v = pdf[key].to_numpy()
            same &= v[1:] == v[:-1]
        change[1:] = ~same
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(pdf))
        rows = []
        for a, b in zip(starts, ends):
            cur, prev = np.cumsum(pdf["n_cur"].to_numpy()[a:b]), np.cumsum(pdf["n_prev"].to_numpy()[a:b])
            rows.append((pdf["column_name"].iat[a], pdf["series"].iat[a], pdf["step"].iat[a], part, seq, cur[-1], prev[-1], int((pdf["n_cur"].to_numpy()[a:b] > 0).sum()), pdf["val"].to_numpy()[a:b], cur, prev))
            seq += 1
        yield pd.DataFrame(rows, columns=["column_name", "series", "step", "part", "seq", "n_cur", "n_prev", "n_values", "vals", "cur", "prev"])


def range_curves(counts: DataFrame) -> DataFrame:
    """Segments of the cumulative curves of counts (column_name, series, step, val, cnt), each load beside the one before.

    Every count enters twice: as the current curve of its own step and as the preceding curve of the next. Rows come
    back with ``off_cur``/``off_prev`` (all counts in segments before) and the totals ``all_cur``/``all_prev``.
    """
    both = counts.select(
        "column_name",
        "series",
        "val",
        F.explode(F.array(F.struct(F.col("step").alias("step"), F.col("cnt").alias("n_cur"), F.lit(0).cast("long").alias("n_prev")), F.struct((F.col("step") + 1).alias("step"), F.lit(0).cast("long").alias("n_cur"), F.col("cnt").alias("n_prev")))).alias("x"),
    ).select("column_name", "series", "x.step", "val", "x.n_cur", "x.n_prev")
    both = both.groupBy("column_name", "series", "step", "val").agg(F.sum("n_cur").alias("n_cur"), F.sum("n_prev").alias("n_prev"))
    order = ["column_name", "series", "step", "val"]
    segments = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_segments, SEGMENT_SCHEMA))
    # the totals of segments, a row each, are added up apart from the segments, whose values stay where they are
    place = ["column_name", "series", "step", "part", "seq"]
    group = Window.partitionBy("column_name", "series", "step")
    before = group.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(
        *place,
        F.coalesce(F.sum("n_cur").over(before), F.lit(0)).alias("off_cur"),
        F.coalesce(F.sum("n_prev").over(before), F.lit(0)).alias("off_prev"),
        F.sum("n_cur").over(group).alias("all_cur"),
        F.sum("n_prev").over(group).alias("all_prev"),
    )
    return segments.join(offsets, place)


def _distance() -> Column:
    gap = "abs((off_cur + x.cur) / all_cur - (off_prev + x.prev) / all_prev)"
    return F.expr(f"array_max(transform(arrays_zip(cur, prev), x -> {gap}))")


def _quantile(q: float) -> Column:
    """The smallest value that a share ``q`` of all values does not exceed, if it lies in this segment."""
    want = f"(ceil({q}D * all_cur) - off_cur)"
    at = f"array_position(transform(cur, c -> c >= {want}), true)"
    return F.max(F.expr(f"CASE WHEN {want} > 0 AND {want} <= n_cur THEN element_at(vals, cast(nullif({at}, 0) as int)) END"))


def quality_profile(table: DataFrame, codebook: DataFrame, *, load: str, series: str, step: str, min_valid: int = 100) -> DataFrame:
    """One row per load and codebook column: counts, distinct values, quantiles and the distance to the load before.

    ``load`` identifies a delivery, ``series`` and ``step`` its place in a row of deliveries. All rows of a load count,
    repeats too. Missing: null, NaN, blank, a sentinel code however written or in brackets behind a label. A column
    of the codebook that the table lacks is left out; a column without valid values has null statistics; the distance
    is null unless this load and the one at ``step - 1`` have ``min_valid`` valid numbers. An empty table gives no rows.
    Rows whose series or step is null have no predecessor but are profiled.
    """
    for name in (load, series, step):
        if name not in table.columns:
            raise InputValidationError(f"no column {name!r}")
    book = read_codebook(codebook, table)
    if not book:
        raise InputValidationError("the codebook names no column of the table")
    own = table.select(F.col(quoted(load)).cast("long").alias("load_id"), F.col(quoted(series)).cast("long").alias("series"), F.col(quoted(step)).cast("long").alias("step"), *(F.col(quoted(r["column"])) for r in book if r["column"] not in ("load_id", "series", "step")))
    # written once: the findings, the curves and the sampling of the range sort all read the counts, not the table
    counts = cut(value_counts(own, book, ["load_id", "series", "step"]))
    n = F.col("cnt")
    basic = counts.groupBy("load_id", "series", "step", "column_name", "is_number").agg(
        F.sum(n).alias("n_rows"),
        F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("out_of_range"), n).otherwise(0)).alias("n_out_of_range"),
        F.sum(F.when(F.col("violates"), n).otherwise(0)).alias("n_pattern_violations"),
        F.count_if(~F.col("missing") & F.col("is_number")).alias("n_numbers"),
        F.count_distinct(F.when(~F.col("missing"), F.col("txt"))).alias("n_texts"),
    )
    numbers = counts.filter(~F.col("missing") & F.col("is_number") & F.col("series").isNotNull() & F.col("step").isNotNull())
    curves = range_curves(numbers.withColumnRenamed("num", "val"))
    shape = curves.groupBy("column_name", "series", "step").agg(
        F.min(F.when(F.col("n_cur") > 0, F.expr("element_at(filter(arrays_zip(vals, cur), x -> x.cur > 0), 1).vals"))).alias("min_value"),
        _quantile(0.25).alias("q25"),
        _quantile(0.5).alias("median"),
        _quantile(0.75).alias("q75"),
        _quantile(1.0).alias("max_value"),
        F.sum("n_values").alias("n_values"),
        F.max(F.when((F.col("all_cur") >= min_valid) & (F.col("all_prev") >= min_valid), _distance())).alias("ks_distance"),
    )
    return basic.join(shape, ["column_name", "series", "step"], "left").select(
        "load_id",
        "series",
        "step",
        "column_name",
        "n_rows",
        "n_missing",
        (F.col("n_missing") / F.col("n_rows")).alias("missing_share"),
        (F.col("n_rows") - F.col("n_missing")).alias("n_valid"),
        F.when(F.col("is_number"), F.coalesce("n_values", "n_numbers")).otherwise(F.col("n_texts")).alias("n_distinct"),
        "min_value",
        "q25",
        "median",
        "q75",
        "max_value",
        "n_out_of_range",
        "n_pattern_violations",
        "ks_distance",
        _lookup(book, "threshold", "double").alias("partial_missing_threshold"),
    )


FINDINGS = ("all_effectively_missing", "single_unique", "partial_missing_over_threshold", "out_of_range", "pattern_violation", "distribution_change")


def findings(profile: DataFrame, *, max_distance: float = 0.4001) -> DataFrame:
    """(load_id, column_name, finding) of a :func:`quality_profile`; a load without an id has none."""
    tests = {
        "all_effectively_missing": F.col("n_valid") == 0,
        "single_unique": F.col("n_distinct") == 1,
        "partial_missing_over_threshold": (F.col("n_valid") > 0) & (F.col("missing_share") > F.col("partial_missing_threshold")),
        "out_of_range": F.col("n_out_of_range") > 0,
        "pattern_violation": F.col("n_pattern_violations") > 0,
        "distribution_change": F.col("ks_distance") > max_distance,
    }
    found = F.array_compact(F.array(*(F.when(tests[name], name) for name in FINDINGS)))
    return profile.filter(F.col("load_id").isNotNull()).select("load_id", "column_name", F.explode(found).alias("finding")).distinct()
