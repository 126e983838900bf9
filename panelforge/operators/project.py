"""Projections: dropping, renaming and resolving columns, identifiers, target encodings."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import NUMERIC, quoted


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputValidationError(f"missing columns: {', '.join(missing)}")


def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without ``columns``; unknown names, repeated names and removing all columns are errors."""
    if len(set(columns)) != len(columns):
        raise InputValidationError("columns to remove are repeated")
    require_columns(df, columns)
    rest = [c for c in df.columns if c not in set(columns)]
    if not rest:
        raise InputValidationError("no column would be left")
    return df.select(*(quoted(c) for c in rest))


def rename_feature(df: DataFrame, old: str, new: str) -> DataFrame:
    """One column under a new name, which must not exist yet."""
    if old not in df.columns:
        near = difflib.get_close_matches(old, df.columns, n=3, cutoff=0.55)
        raise InputValidationError(f"no column {old!r}" + (f"; close names: {', '.join(near)}" if near else ""))
    if not new.strip() or new in df.columns:
        raise InputValidationError(f"{new!r} is blank or exists already")
    return df.select(*(F.col(quoted(c)).alias(new if c == old else c) for c in df.columns))


def prefix_columns(df: DataFrame, alias: str, keys: Sequence[str]) -> DataFrame:
    """All columns but ``keys`` as ``{alias}__{column}``."""
    return df.select(*(F.col(quoted(c)).alias(c if c in keys else f"{alias}__{c}") for c in df.columns))


def resolve_column(columns: Sequence[str], wanted: str) -> str | None:
    """The column of this name, without regard to case where no exact one exists; ties go to the first."""
    if wanted in columns:
        return wanted
    return next((c for c in columns if c.lower() == wanted.lower()), None)


def resolve_features(df: DataFrame, wanted: Mapping[str, tuple[str, str | None]]) -> dict[str, str | None]:
    """The column for each feature name, given (source, scope).

    An exact source wins; else columns ending in ``__{source}`` (of the scope's alias if any), the fullest first, then
    by name. All ambiguous features are counted in one aggregate.
    """
    options: dict[str, list[str]] = {}
    for name, (source, scope) in wanted.items():
        exact = resolve_column(df.columns, source)
        if exact:
            options[name] = [exact]
            continue
        ends = [c for c in df.columns if c.lower().endswith("__" + source.lower())]
        scoped = [c for c in ends if scope and scope.lower() in c.lower().split("__")[0]]
        options[name] = scoped or ends
    unclear = sorted({c for x in options.values() if len(x) > 1 for c in x})
    filled = df.agg(*(F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(unclear))).first() if unclear else []
    count = dict(zip(unclear, filled))
    return {name: min(x, key=lambda c: (-count.get(c, 0), c)) if x else None for name, x in options.items()}


def select_wave_features(df: DataFrame, keep: Sequence[str], longitudinal: Mapping[str, tuple[str, str | None]], static: Mapping[str, tuple[str, str | None]], wave: str) -> tuple[DataFrame, list[str]]:
    """Protected columns, ``{canonical}`` and ``non_long__{wave}__{name}``; also the names that no column resolves."""
    found = resolve_features(df, {**longitudinal, **{f"\0{k}": v for k, v in static.items()}})
    out = [F.col(quoted(c)) for c in keep]
    out += [F.col(quoted(c)).alias(n) for n, c in found.items() if c and not n.startswith("\0")]
    out += [F.col(quoted(c)).alias(f"non_long__{wave.lower()}__{n[1:]}") for n, c in found.items() if c and n.startswith("\0")]
    return df.select(*out), [n.lstrip("\0") for n, c in found.items() if not c]


def numeric_columns(df: DataFrame, leave: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in leave]


def child_identifier(family: Column, number: Column) -> Column:
    """``family_number``; null if either is null."""
    return F.concat(family.cast("string"), F.lit("_"), number.cast("string"))


def slot_label(number: Column, prefix: str = "p") -> Column:
    """``p{n}`` for a positive number, else null."""
    return F.when(number > 0, F.concat(F.lit(prefix), number.cast("long").cast("string")))


def label_codes(df: DataFrame, target: str) -> tuple[DataFrame, dict[str, int]]:
    """A target as codes 0.. in the order of its sorted labels, in column ``{target}_code``; null stays null.

    The labels of a classification target are few; more than 10000 are refused rather than collected.
    """
    labels = [r[0] for r in df.select(F.col(quoted(target)).cast("string").alias("l")).filter("l IS NOT NULL").distinct().orderBy("l").limit(10_001).collect()]
    if len(labels) > 10_000:
        raise InputValidationError(f"{target!r} has too many labels for a class target")
    codes = {x: i for i, x in enumerate(labels)}
    text = F.col(quoted(target)).cast("string")
    code = F.create_map(*(F.lit(y) for x in codes.items() for y in x))[text] if codes else F.lit(None)
    return df.withColumn(f"{target}_code", code.cast("long")), codes


def slug(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", label.strip().lower()).strip("_") or "label"


def scenario_names(labels: Sequence[str]) -> dict[str, str]:
    """Scenario key of each label, labels sorted as text; equal slugs get their position."""
    out: dict[str, str] = {}
    for i, label in enumerate(sorted(map(str, labels))):
        key = f"traj_{slug(label)}_vs_rest"
        out[label] = f"{key}_{i}" if key in out.values() else key
    return out


def one_vs_rest(df: DataFrame, target: str, labels: Sequence[str] | None = None) -> DataFrame:
    """A 0/1 column for each label of ``target``, named by :func:`scenario_names`; a null target gives null."""
    if labels is None:
        labels = list(label_codes(df, target)[1])
    text = F.col(quoted(target)).cast("string")
    return df.select("*", *((text == label).cast("int").alias(name) for label, name in scenario_names(labels).items()))


