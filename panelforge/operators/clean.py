"""Type cleaning, harmonising of categories, correlation and structural profiles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import NUMBER, NUMERIC, integral_text, is_missing, not_nan, numeric, quoted, strip
from panelforge.operators.ranks import prefix_counts

# Texts that readers of delimited files take for a missing value.
NULL_TEXTS = ("", "NA", "N/A", "NaN", "nan", "-NaN", "-nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, codes: Sequence[float] = (), *, chunk: int = 100) -> DataFrame:
    """(column_name, n_rows, na_count, effective_missing_count, effective_missing_rate, valid_count, nunique_valid, dtype).

    Cells are unpivoted and counted per (column, value) first, so distinct counts are exact without one expansion per
    column; effectively missing means null, NaN or one of ``codes`` however written.
    """
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        value = integral_text(numeric(df, c)) if isinstance(df.schema[c].dataType, NUMERIC) else F.col(quoted(c)).cast("string")
        return F.struct(F.lit(c).alias("column_name"), is_missing(df, c).alias("na"), is_missing(df, c, codes).alias("missing"), value.alias("value"))

    parts = [df.select(F.explode(F.array(*map(cell, names[i : i + chunk]))).alias("x")).select("x.*") for i in range(0, len(names), chunk)]
    cells = reduce(DataFrame.unionByName, parts).withColumn("value", F.when(~F.col("missing"), F.col("value")))
    counted = cells.groupBy("column_name", "na", "missing", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    out = counted.groupBy("column_name").agg(
        F.sum(n).alias("n_rows"),
        F.sum(F.when(F.col("na"), n).otherwise(0)).alias("na_count"),
        F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("effective_missing_count"),
        F.count_if(~F.col("missing")).alias("nunique_valid"),
    )
    dtype = F.create_map(*(F.lit(x) for c in names for x in (c, kinds[c])))[F.col("column_name")]
    return out.select("column_name", "n_rows", "na_count", "effective_missing_count", (F.col("effective_missing_count") / F.col("n_rows")).alias("effective_missing_rate"), (F.col("n_rows") - F.col("effective_missing_count")).alias("valid_count"), "nunique_valid", dtype.alias("dtype"))


def clean_types(df: DataFrame, *, drop_null_fraction: float | None = 1.0, drop_if_constant: bool = False, drop_if_unique: bool = False, datetime_format: str | None = None, cast_to_str: bool = False, numeric_to_float32: bool = False) -> DataFrame:
    """Texts that mean missing become null; a text column becomes number or timestamp if every value is one; columns
    are dropped that are null in at least ``drop_null_fraction`` (1.0: all) of rows, constant, or of text that differs in every row.

    One job profiles all columns. NaN becomes null. With ``cast_to_str`` other types than numbers, booleans and
    timestamps become text; with ``numeric_to_float32`` numbers become floats. An empty table keeps its columns.
    """
    if drop_null_fraction is not None and not 0 <= drop_null_fraction <= 1:
        raise InputValidationError("drop_null_fraction must lie between 0 and 1")
    base = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            base.append(F.when(~strip(c).isin(*NULL_TEXTS), c).alias(f.name))
        else:
            base.append(not_nan(c, f.dataType).alias(f.name))
    tidy = df.select(*base)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    moment = lambda c: F.try_to_timestamp(strip(F.col(quoted(c))), F.lit(datetime_format)) if datetime_format else F.when(strip(F.col(quoted(c))).rlike(r"^\d{4}-\d{2}-\d{2}"), strip(F.col(quoted(c))).try_cast("timestamp"))
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        exprs += [F.count(quoted(c)).alias(f"c{i}"), F.min(quoted(c)).eqNullSafe(F.max(quoted(c))).alias(f"k{i}")] if df.schema[c].dataType.simpleString() not in ("map", "variant") else [F.count(quoted(c)).alias(f"c{i}"), F.lit(False).alias(f"k{i}")]
    for i, c in enumerate(texts):
        exprs += [F.count_if(strip(F.col(quoted(c))).rlike(NUMBER)).alias(f"num{i}"), F.count(moment(c)).alias(f"time{i}")]
    p = tidy.agg(*exprs).first()
    n = p["n"]
    # a text column that stays text and has as many values as there are rows
    stays = [c for i, c in enumerate(texts) if drop_if_unique and n and p[f"c{df.columns.index(c)}"] == n and n not in (p[f"num{i}"], p[f"time{i}"])]
    distinct = tidy.agg(*(F.count_distinct(quoted(c)) for c in stays)).first() if stays else []
    unique = {c for c, k in zip(stays, distinct) if k == n}
    out = []
    for i, f in enumerate(df.schema):
        there, c = p[f"c{i}"], F.col(quoted(f.name))
        if n and drop_null_fraction is not None and there < n and (n - there) / n >= drop_null_fraction:
            continue
        if (drop_if_constant and n and there == n and p[f"k{i}"]) or f.name in unique:
            continue
        kind = f.dataType
        if f.name in texts and there:
            t = texts.index(f.name)
            if p[f"num{t}"] == there:
                c, kind = strip(c).try_cast("double"), T.DoubleType()
            elif p[f"time{t}"] == there:
                c, kind = moment(f.name), T.TimestampType()
        if numeric_to_float32 and isinstance(kind, NUMERIC):
            c = c.cast("float")
        elif cast_to_str and not isinstance(kind, (*NUMERIC, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return tidy.select(*out)


def time_axis(df: DataFrame, time: str) -> Column:
    """The time column as number if all values are, else as timestamp if all are, else as text: one aggregate decides."""
    if not isinstance(df.schema[time].dataType, T.StringType):
        return F.col(quoted(time))
    c = strip(F.col(quoted(time)))
    p = df.agg(F.count(c).alias("n"), F.count_if(c.rlike(NUMBER)).alias("num"), F.count(c.try_cast("timestamp")).alias("ts")).first()
    if p["n"] and p["num"] == p["n"]:
        return c.try_cast("double")
    return c.try_cast("timestamp") if p["n"] and p["ts"] == p["n"] else F.col(quoted(time))


def _trigrams(text: str) -> set[str]:
    padded = f"  {text} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _gram_distances(keys: list[str]) -> np.ndarray:
    """Jaccard distances of the labels' character trigrams, from one product of label and trigram indicators."""
    grams = [_trigrams(k) for k in keys]
    at: dict[str, int] = {}
    for g in grams:
        for x in sorted(g):
            at.setdefault(x, len(at))
    has = np.zeros((len(keys), max(1, len(at))), np.float32)
    for i, g in enumerate(grams):
        has[i, [at[x] for x in g]] = 1
    both, size = (has @ has.T).astype(float), has.sum(1).astype(float)
    return 1 - both / (size[:, None] + size[None, :] - both)


def _average_linkage(dist: np.ndarray, n_clusters: int, limit: float) -> np.ndarray:
    """The cluster of each item after merging the two nearest (ties: the first) until ``n_clusters`` are left or the least
    distance exceeds ``limit``. Every item keeps its nearest later neighbour, so a merge looks at one row and column only."""
    n = len(dist)
    to, size = np.arange(n), np.ones(n)
    d = np.where(np.triu(np.ones((n, n), bool), 1), dist, np.inf)
    near = d.argmin(1) if n else np.zeros(0, int)
    least = d[np.arange(n), near]
    for _ in range(n - n_clusters):
        a = int(least.argmin())
        if not np.isfinite(least[a]) or least[a] > limit:
            break
        b = int(near[a])
        of_a, of_b = np.minimum(d[a], d[:, a]), np.minimum(d[b], d[:, b])
        new = (size[a] * of_a + size[b] * of_b) / (size[a] + size[b])
        new[[a, b]] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        d[a, a + 1 :], d[:a, a] = new[a + 1 :], new[:a]
        size[a] += size[b]
        to[to == b] = a
        for i in np.flatnonzero((near == a) | (near == b) | (np.arange(n) == a)):
            near[i] = d[i].argmin()
            least[i] = d[i, near[i]]
        closer = np.flatnonzero((d[:a, a] < least[:a]) | ((d[:a, a] == least[:a]) & (near[:a] > a)))
        near[closer], least[closer] = a, d[closer, a]
        least[b] = np.inf
    return to


def cluster_labels(counts: dict[str, int], n_clusters: int | None = None, limit: float = 0.6) -> dict[str, str]:
    """Label -> representative. Labels that differ in case, blanks and punctuation only are one; the rest are joined by
    average linkage over the Jaccard distance of character trigrams until ``n_clusters`` are left, or the least distance exceeds
    ``limit``. The representative is the most frequent label (ties: the first in the alphabet)."""
    groups: dict[str, list[str]] = defaultdict(list)
    for label in counts:
        groups["".join(ch for ch in label.casefold() if ch.isalnum()) or label].append(label)
    keys = sorted(groups)
    clusters = [sorted(groups[k]) for k in keys]
    merged = _average_linkage(_gram_distances(keys), n_clusters or 1, np.inf if n_clusters else limit)
    members: dict[int, list[int]] = defaultdict(list)
    for i, m in enumerate(merged):
        members[m].append(i)
    out = {}
    for own in members.values():
        labels = [x for i in own for x in clusters[i]]
        best = min(labels, key=lambda x: (-counts[x], x))
        out |= {x: best for x in labels}
    return out


def harmonise_categories(df: DataFrame, columns: Sequence[str], n_clusters: int | None = None, *, max_labels: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(table with harmonised labels, mapping of column, original, harmonised).

    Only a column's distinct labels (at most ``max_labels``, else an error: it is no category then) reach the driver.
    Columns with fewer than two labels and nulls stay as they are.
    """
    if n_clusters is not None and n_clusters < 2:
        raise InputValidationError("n_clusters must be at least 2")
    spark, rows, out = df.sparkSession, [], df
    for c in columns:
        text = F.col(quoted(c)).cast("string")
        counts = {r["v"]: r["n"] for r in df.select(text.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()}
        if len(counts) > max_labels:
            raise InputValidationError(f"{c!r} has more than {max_labels} labels")
        if len(counts) < 2:
            continue
        mapping = cluster_labels(counts, min(n_clusters, len(counts)) if n_clusters else None)
        rows += [(c, a, b) for a, b in sorted(mapping.items())]
    table = spark.createDataFrame(rows, "column string, original string, harmonised string")
    for c in columns:
        own = {a: b for x, a, b in rows if x == c}
        if own:
            to = F.create_map(*(F.lit(x) for kv in own.items() for x in kv))
            out = out.withColumn(c, to[F.col(quoted(c)).cast("string")])
    return out, table


def spearman_pairs(df: DataFrame, columns: Sequence[str], *, threshold: float = 0.0) -> DataFrame:
    """(feature_a, feature_b, n, rho, abs_rho) of all column pairs over the rows where both have a number.

    Ranks are average ranks within the pair's own complete rows, as pairwise deletion asks for. Values are reduced to
    counts per (pair, value a, value b) before ranking; a rank is then a prefix count
    over range-sorted distinct values, so no pair is ranked in one task. Fewer than two rows or a constant column give no pair.
    """
    names = sorted(columns)
    pairs = list(combinations(names, 2))
    if not pairs:
        raise InputValidationError("two columns at least are needed")
    base = df.select(*(numeric(df, c).alias(f"c{i}") for i, c in enumerate(names)))
    at = {c: i for i, c in enumerate(names)}
    cells = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"c{at[a]}").alias("x"), F.col(f"c{at[b]}").alias("y")) for k, (a, b) in enumerate(pairs)))
    rows = base.select(F.explode(cells).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    counts = rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    counts = cut(counts)

    def ranks(value: str) -> DataFrame:
        per = prefix_counts(counts.groupBy("pair", value).agg(F.sum("n").alias("m")), ["pair"], value, ["m"])
        return per.select("pair", value, (F.col("m_before") + (F.col("m") + 1) / 2).alias(f"r{value}"))

    ranked = counts.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"])
    s = lambda e: F.sum(F.expr(e))
    sums = ranked.groupBy("pair").agg(s("n").alias("n"), s("n * rx").alias("sx"), s("n * ry").alias("sy"), s("n * rx * rx").alias("sxx"), s("n * ry * ry").alias("syy"), s("n * rx * ry").alias("sxy"))
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    out = sums.filter((vx > 0) & (vy > 0)).withColumn("rho", F.expr("n * sxy - sx * sy") / F.sqrt(vx * vy)).withColumn("abs_rho", F.abs("rho"))
    first = F.array(*(F.lit(a) for a, _ in pairs))
    second = F.array(*(F.lit(b) for _, b in pairs))
    return out.filter(F.col("abs_rho") >= threshold).select(F.get(first, F.col("pair")).alias("feature_a"), F.get(second, F.col("pair")).alias("feature_b"), "n", "rho", "abs_rho")


def prune_correlated(pairs: Sequence[tuple[str, str, float]], missing_rate: dict[str, float]) -> list[tuple[str, str, str, float]]:
    """(dropped, kept, reason, abs_rho): for each pair, strongest first, the feature with more missing values goes, in a tie the
    one later in the alphabet; pairs that touch a dropped feature are passed over."""
    gone: set[str] = set()
    out = []
    for a, b, rho in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a in gone or b in gone:
            continue
        ma, mb = missing_rate.get(a, 0.0), missing_rate.get(b, 0.0)
        lose = max(a, b) if ma == mb else (a if ma > mb else b)
        gone.add(lose)
        out.append((lose, b if lose == a else a, "tie" if ma == mb else "more_missing", rho))
    return out


