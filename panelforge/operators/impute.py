"""Imputation (I1-I5). NaN counts as missing; columns without any value stay as they are."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import FLOATS, NUMERIC, not_nan, quoted
from panelforge.operators.aggregate import missing_cells
from panelforge.operators.ranks import exact_quantiles

SIMPLE = ("mean_imputation", "median_imputation", "most_frequent_imputation", "constant_imputation")
IMPUTERS = (*SIMPLE, "mice_imputation")


def impute(df: DataFrame, imputer: str, *, columns: Sequence[str] | None = None, fill_value=None, **options) -> DataFrame:
    """``df`` without missing values in the columns the imputer can fill.

    mean, median: numeric columns, which become double; most_frequent: all columns (ties: the least value); constant:
    all columns, 0 for numbers and ``missing`` for others unless ``fill_value`` is given (a text may be a JSON
    literal; a text filled into a number makes the column text). Cells that have a value keep it.
    """
    if imputer not in IMPUTERS:
        raise InputValidationError(f"imputer must be one of {', '.join(IMPUTERS)}")
    if imputer == "mice_imputation":
        return mice(df, columns, **options)
    if options:
        raise InputValidationError(f"{imputer} takes no {', '.join(options)}")
    chosen = list(columns or df.columns)
    if imputer == "constant_imputation":
        return _constant(df, chosen, fill_value)
    numbers = [c for c in chosen if isinstance(df.schema[c].dataType, NUMERIC)]
    if imputer != "most_frequent_imputation":
        if not numbers:
            if missing_cells(df).first()["missing_cells"]:
                raise InputValidationError("there are missing cells but no numeric column")
            return df
        chosen = numbers
    value = {c: not_nan(F.col(quoted(c)), df.schema[c].dataType) for c in chosen}
    fill = fill_values(df, chosen, imputer)
    out = []
    for c in df.columns:
        if c not in fill:
            out.append(F.col(quoted(c)))
        elif imputer == "most_frequent_imputation":
            out.append(F.coalesce(value[c], F.lit(fill[c]).cast(df.schema[c].dataType)).alias(c))
        else:
            out.append(F.coalesce(value[c].cast("double"), F.lit(float(fill[c]))).alias(c))
    return df.select(*out)


def fill_values(df: DataFrame, columns: Sequence[str], imputer: str) -> dict:
    """The fill value of each column that has any value; a row per column reaches the driver.

    Means are one aggregate. Medians and modes are taken from counts per (column, value), so a column with many values
    is never held in one task.
    """
    value = {c: not_nan(F.col(quoted(c)), df.schema[c].dataType) for c in columns}
    if imputer == "mean_imputation":
        row = df.agg(*(F.avg(value[c]).alias(f"f{i}") for i, c in enumerate(columns))).first() if columns else []
        return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    texts = [c for c in columns if c not in numbers] if imputer == "most_frequent_imputation" else []
    out: dict = {}
    for own, kind in ((numbers, "double"), (texts, "string")):
        if not own:
            continue
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), value[c].cast(kind).alias("v")) for c in own))).alias("x")).select("x.*").filter("v IS NOT NULL")
        counts = cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        if imputer == "median_imputation":
            best = exact_quantiles(counts, ["c"], "v", "n", [0.5]).select("c", F.col("q0").alias("v"))
        else:
            best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        out |= {r["c"]: r["v"] for r in best.collect()}
    return out


def _constant(df: DataFrame, columns: Sequence[str], fill) -> DataFrame:
    if isinstance(fill, str):
        try:
            fill = json.loads(fill)
        except ValueError:
            pass
    out = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if f.name not in columns:
            out.append(c)
            continue
        number = isinstance(f.dataType, NUMERIC)
        own = fill if fill is not None else (0 if number else "missing")
        value = not_nan(c, f.dataType)
        if number and isinstance(own, (int, float)) and not isinstance(own, bool):
            kind = f.dataType if isinstance(f.dataType, FLOATS) or float(own).is_integer() else T.DoubleType()
            out.append(F.coalesce(value.cast(kind), F.lit(own).cast(kind)).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType) and isinstance(own, bool):
            out.append(F.coalesce(value, F.lit(own)).alias(f.name))
        else:
            out.append(F.coalesce(value.cast("string"), F.lit(str(own))).alias(f.name))
    return df.select(*out)


def imputation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: missing cells before and after."""
    a = missing_cells(before).select(F.lit("missing_before").alias("k"), "missing_cells")
    b = missing_cells(after).select(F.lit("missing_after").alias("k"), "missing_cells")
    return a.unionByName(b).agg(*(F.max(F.when(F.col("k") == k, F.col("missing_cells"))).alias(k) for k in ("missing_before", "missing_after")))


def mice(df: DataFrame, columns: Sequence[str] | None = None, *, iterations: int = 5, num_datasets: int = 1, dataset_index: int = 0, mean_match_candidates: int = 5, random_state: int = 42) -> DataFrame:
    """Multivariate imputation by chained equations with predictive mean matching for numeric columns; texts by mode.

    Each round regresses every incomplete column on the others. The normal equations are sums over rows, so one
    aggregate a column gives the regression; missing cells then take the observed value of one of the
    ``mean_match_candidates`` observed rows whose predictions are nearest; of rows that tie for the last places each is
    as likely. Donors are all observed rows, as exact counts per (prediction, observed value), and choices depend on a hash
    of the row and the seed, so runs repeat. ``dataset_index`` picks one of ``num_datasets`` imputations, which differ in
    their seed only.
    """
    if not 0 <= dataset_index < num_datasets or iterations < 1 or mean_match_candidates < 1:
        raise InputValidationError("iterations, candidates and dataset index must be positive and in range")
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)])
    lacks = {c: (F.col(quoted(c)).isNull() | (F.isnan(quoted(c)) if isinstance(df.schema[c].dataType, FLOATS) else F.lit(False))) for c in names}
    counts = df.agg(*(F.count_if(x).alias(f"n{i}") for i, x in enumerate(lacks.values())), F.count(F.lit(1)).alias("n")).first() if names else None
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    base = impute(df, "most_frequent_imputation", columns=texts) if texts else df
    gaps = [c for i, c in enumerate(names) if 0 < counts[i] < counts["n"]] if names else []
    if not gaps:
        return base
    usable = [c for i, c in enumerate(names) if counts[i] < counts["n"]]
    seed = random_state + 7919 * dataset_index
    work = base.select("*", *(lacks[c].alias(f"__gap_{i}") for i, c in enumerate(gaps)), F.xxhash64(*(F.col(quoted(c)) for c in base.columns)).alias("__row"))
    filled = impute(work, "mean_imputation", columns=usable)
    filled = cut(filled)
    for step in range(iterations):
        for i, c in enumerate(gaps):
            others = [x for x in usable if x != c]
            beta = _regression(filled.filter(~F.col(f"__gap_{i}")), c, others)
            prediction = F.lit(float(beta[0]))
            for b, x in zip(beta[1:], others):
                prediction = prediction + F.lit(float(b)) * F.col(quoted(x))
            seen = filled.filter(~F.col(f"__gap_{i}")).select(prediction.alias("p"), F.col(quoted(c)).cast("double").alias("y"))
            salt = seed * 1000 + step * 100 + i
            new = F.when(F.col(f"__gap_{i}"), _matched(seen, prediction, mean_match_candidates, salt)).otherwise(F.col(quoted(c)))
            filled = filled.select(*((new.alias(c) if x == c else F.col(quoted(x))) for x in filled.columns))
        filled = cut(filled)
    return filled.select(*(quoted(c) for c in df.columns))


def _matched(seen: DataFrame, prediction: Column, k: int, salt: int, max_donors: int = 200_000) -> Column:
    """The value that a row with ``prediction`` draws from the rows (p, y) of ``seen``.

    Donors reach the driver as counts per (p, y). More than ``max_donors`` of them are taken in ranges of predictions, one
    at a time, each with the ``k`` next predictions on both sides, so that all are used and a range decides alone.
    """
    counts = seen.groupBy("p", "y").agg(F.count(F.lit(1)).alias("n"))
    spark, row = seen.sparkSession, F.col("__row")
    first = counts.limit(max_donors + 1).toPandas()
    if len(first) <= max_donors:
        return _matcher(spark, first, k, salt)(prediction, row)
    counts = cut(counts)
    parts = -(-counts.count() // max_donors)
    edges = sorted(set(counts.agg(F.percentile_approx("p", [q / parts for q in range(1, parts)], 10_000).alias("q")).first()["q"]))
    points = counts.select("p").distinct()
    out = None
    for lo, hi in zip([None, *edges], [*edges, None]):
        kept = F.lit(True)
        if lo is not None:
            below = points.filter(F.col("p") < lo).orderBy(F.desc("p")).limit(k).agg(F.min("p")).first()[0]
            kept = kept & (F.col("p") >= (lo if below is None else below))
        if hi is not None:
            above = points.filter(F.col("p") >= hi).orderBy("p").limit(k).agg(F.max("p")).first()[0]
            kept = kept & (F.col("p") <= (hi if above is None else above))
        value = _matcher(spark, counts.filter(kept).toPandas(), k, salt)(prediction, row)
        out = F.when(prediction >= lo, value).otherwise(out) if lo is not None else value
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-spread 64-bit numbers of hashes and a salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def draw_donors(points: np.ndarray, rows: np.ndarray, wanted: np.ndarray, hashes: np.ndarray, k: int, salt: int) -> np.ndarray:
    """For each of ``wanted`` the number of a donor among its ``k`` nearest.

    ``points`` are the sorted distinct predictions and ``rows`` the donors up to each (from 0). The last point taken may
    have more donors than places are left: the places go to any of them, each as likely.
    """
    k = min(k, int(rows[-1]))
    lo = np.searchsorted(points, wanted)
    hi, last = lo.copy(), lo.copy()
    for _ in range(k):
        short = rows[hi] - rows[lo] < k
        down = np.where(lo > 0, wanted - points[np.maximum(lo - 1, 0)], np.inf)
        up = np.where(hi < len(points), points[np.minimum(hi, len(points) - 1)] - wanted, np.inf)
        left, right = short & (down < up), short & (down >= up)
        last = np.where(left, lo - 1, np.where(right, hi, last))
        lo, hi = lo - left, hi + right
    inner = rows[hi] - rows[lo] - (rows[last + 1] - rows[last])
    place = (_mixed(hashes, salt) % np.uint64(k)).astype(np.int64)
    tied = rows[last] + (_mixed(hashes, ~salt) % (rows[last + 1] - rows[last]).astype(np.uint64)).astype(np.int64)
    return np.where(place < inner, np.where(last == lo, rows[lo + 1], rows[lo]) + place, tied)


def _matcher(spark: SparkSession, donors: pd.DataFrame, k: int, salt: int):
    """The function that draws a donor's value by prediction and hash of the row."""
    donors = donors.sort_values(["p", "y"], ignore_index=True)
    points, at = np.unique(donors["p"].to_numpy(), return_index=True)
    up_to = np.cumsum(donors["n"].to_numpy())
    shared = spark.sparkContext.broadcast((points, np.r_[0, up_to[np.r_[at[1:], len(donors)] - 1]], up_to, donors["y"].to_numpy(float)))

    @F.pandas_udf("double")
    def match(p: pd.Series, row: pd.Series) -> pd.Series:
        points, rows, up_to, y = shared.value
        return pd.Series(y[np.searchsorted(up_to, draw_donors(points, rows, p.to_numpy(float), row.to_numpy(np.int64), k, salt), "right")])

    return match


def _regression(rows: DataFrame, target: str, others: Sequence[str]) -> np.ndarray:
    """Ridge-stabilised least squares from one aggregate of cross products."""
    terms = [F.lit(1.0), *(F.col(quoted(x)).cast("double") for x in others)]
    y, n = F.col(quoted(target)).cast("double"), len(terms)
    made = [F.sum(terms[a] * terms[b]).alias(f"x{a}_{b}") for a in range(n) for b in range(a, n)] + [F.sum(t * y).alias(f"y{a}") for a, t in enumerate(terms)]
    r = rows.agg(*made).first()
    xx, xy = np.zeros((n, n)), np.array([r[f"y{a}"] or 0.0 for a in range(n)])
    for a in range(n):
        for b in range(a, n):
            xx[a, b] = xx[b, a] = r[f"x{a}_{b}"] or 0.0
    return np.linalg.lstsq(xx + 1e-8 * np.diag(np.diag(xx) + 1e-12), xy, rcond=None)[0]


