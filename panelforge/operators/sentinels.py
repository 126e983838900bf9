"""Sentinel codes: filters, detection by label, replacement, compact maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.exprs import is_missing, numeric, quoted
from panelforge.operators.encode import column_role

# Codes that stand for a missing answer, and label fragments that mark one.
SENTINEL_CODES = (-9, -8, -7, -6, -5, -4, -3, -2, -1, 96, 97, 98, 99, 996, 997, 998, 999)
MISSING_TERMS = (
    "don't know", "dont know", "do not know", "refusal", "refused", "not applicable", "not app", "not appl", "inapplicable", "not asked",
    "not answered", "not answer", "missing", "no answer", "do not wish to answer", "don't wish to answer", "not available", "invalid",
    "unable to answer", "can't say",
)


def target_rows(df: DataFrame, target: str, codes: Sequence[float] = SENTINEL_CODES) -> DataFrame:
    """Rows whose target is observed: not null, NaN or a sentinel code."""
    return df.filter(~is_missing(df, target, codes))


def target_row_summary(df: DataFrame, target: str, codes: Sequence[float] = SENTINEL_CODES) -> DataFrame:
    """One row: rows before and after :func:`target_rows`, null targets and sentinel targets, and their share."""
    null = is_missing(df, target)
    missing = is_missing(df, target, codes)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("rows_before"),
        F.count_if(~missing).alias("rows_after"),
        F.count_if(null).alias("null_targets"),
        F.count_if(missing & ~null).alias("sentinel_targets"),
        (F.count_if(missing) / n).alias("removed_share"),
    )


def replace_sentinels(df: DataFrame, codes: Mapping[str, Sequence[float]]) -> DataFrame:
    """The listed codes of each column become null, however they are written; all in one projection."""
    made = []
    for c in df.columns:
        own = [float(x) for x in codes.get(c, ())]
        col = F.col(quoted(c))
        made.append(F.when(~F.coalesce(numeric(df, c).isin(own), F.lit(False)), col).alias(c) if own else col)
    return df.select(*made)


def replacement_counts(df: DataFrame, codes: Mapping[str, Sequence[float]]) -> DataFrame:
    """(column_name, replaced) in one aggregate over all columns."""
    counted = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.coalesce(numeric(df, c).isin([float(x) for x in v]), F.lit(False))).alias("replaced")) for c, v in codes.items() if v]
    return df.agg(F.array(*counted).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def observed_codes(df: DataFrame, columns: Sequence[str], codes: Sequence[float] = SENTINEL_CODES) -> DataFrame:
    """(column_name, code, n): how often each sentinel code occurs in each column."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), numeric(df, c).alias("code")) for c in columns))
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("code").isin([float(x) for x in codes]))
    return rows.groupBy("column_name", F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def label_codes(df: DataFrame, columns: Sequence[str], terms: Sequence[str] = MISSING_TERMS) -> DataFrame:
    """(column_name, code): numbers in the text of labels that hold a missing-like term, such as ``Refused (-8)``."""
    own = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not own:
        return df.sparkSession.createDataFrame([], "column_name string, code long")
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lower(F.col(quoted(c))).alias("label")) for c in own))
    pattern = "|".join(t.replace("'", "['’]") for t in terms)
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter(F.col("label").rlike(pattern)).distinct()
    code = F.regexp_extract("label", r"(-?\d+)", 1).try_cast("long")
    return rows.select("column_name", code.alias("code")).filter("code IS NOT NULL").distinct()


def choose_codes(columns: Sequence[str], overrides: Mapping[str, Sequence[float]], labelled: Mapping[str, set], observed: Mapping[str, set], fallback: bool = True) -> dict[str, tuple[str, list[int]]]:
    """(status, codes) of each column: a root's override first, then codes of labels, then observed codes."""
    roots = {k.lower(): sorted(int(x) for x in v) for k, v in overrides.items()}
    out = {}
    for c in columns:
        root = column_role(c).root.lower()
        if root in roots:
            out[c] = ("root_override", roots[root])
        elif labelled.get(c):
            out[c] = ("label_terms", sorted(labelled[c]))
        elif fallback and observed.get(c):
            out[c] = ("observed_fallback", sorted(observed[c]))
        else:
            out[c] = ("none", [])
    return out


def compact_map(chosen: Mapping[str, tuple[str, list[int]]]) -> list[tuple[str, list[int], list[int]]]:
    """(root, waves, codes) of the columns that have codes."""
    roots: dict[str, tuple[set, set]] = {}
    for c, (_, codes) in chosen.items():
        if codes:
            role = column_role(c)
            waves, all_codes = roots.setdefault(role.root, (set(), set()))
            waves.add(role.wave or 0)
            all_codes.update(codes)
    return [(r, sorted(w), sorted(c)) for r, (w, c) in sorted(roots.items())]


