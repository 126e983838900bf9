"""Preparation pipeline: keyed source tables of several waves to one long or wide panel (PP1, PP2, P3-P7, J2-J8, R3-R5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import family_key, number, quoted
from panelforge.operators import encode, joins, project, reshape

ROLES = {"family": ("MCSID",), "child": ("MCSID", "CNUM"), "parent": ("MCSID", "PNUM"), "link": ("MCSID", "CNUM", "PNUM")}
FIXED = ("CHID", "wave", "MCSID", "CNUM")


@dataclass
class SourceTable:
    """One source table of a wave: its role, alias and the columns that hold its child and parent numbers."""

    role: str
    alias: str
    data: DataFrame
    cnum_source: str | None = None
    pnum_source: str | None = None
    excluded: bool = False


@dataclass
class WaveInput:
    """``longitudinal`` and ``static`` map an output name to (source column, alias scope or None)."""

    wave: str
    tables: Sequence[SourceTable]
    longitudinal: Mapping[str, tuple[str, str | None]] = field(default_factory=dict)
    static: Mapping[str, tuple[str, str | None]] = field(default_factory=dict)


@dataclass(frozen=True)
class Composite:
    """An output column as a row-wise reduction of input columns."""

    output: str
    inputs: tuple[str, ...]
    how: str
    waves: tuple[str, ...] = ()


@dataclass
class Prepared:
    long: DataFrame | None
    wide: DataFrame | None
    unresolved: dict[str, list[str]]
    coverage: list[dict]


def standard_keys(table: SourceTable) -> DataFrame:
    """The table with its role's keys under their standard names and all other columns as ``{alias}__{column}``.

    The family id is found without regard to case; blank and filler ids, and child or parent numbers that are no positive
    number, are missing keys, and rows with a missing key are left out.
    """
    if table.role not in ROLES:
        raise InputValidationError(f"unknown role {table.role!r}")
    df, made, used = table.data, {}, set()
    for key, source in zip(("MCSID", "CNUM", "PNUM"), ("MCSID", table.cnum_source, table.pnum_source)):
        if key not in ROLES[table.role]:
            continue
        column = project.resolve_column(df.columns, source or key)
        if column is None:
            raise InputValidationError(f"{table.alias}: no column {source or key!r} for {key}")
        used.add(column)
        c = F.col(quoted(column))
        made[key] = family_key(c) if key == "MCSID" else F.when(number(c) > 0, number(c).cast("long"))
    used |= {c for c in df.columns if c.lower() == "mcsid"}
    rest = [F.col(quoted(c)).alias(f"{table.alias}__{c}") for c in df.columns if c not in used]
    return df.select(*(c.alias(k) for k, c in made.items()), *rest).dropna(subset=list(made))


def subject_table(wave: WaveInput, *, parent_slots: Sequence[str] = ("p1", "p2"), validate: bool = True) -> tuple[DataFrame, list[dict]]:
    """One row per child of a wave: anchor of all children in child and link tables, child and family columns, and the
    columns of linked parents per slot. Keys must be unique within each table."""
    tables = [(t, standard_keys(t)) for t in wave.tables if not t.excluded]
    by_role = lambda *r: [(t, d) for t, d in tables if t.role in r]
    children = by_role("child", "link")
    if not children:
        raise InputValidationError(f"{wave.wave}: no child or link table")
    anchor = reshape.union_keys([d for _, d in children], ["MCSID", "CNUM"])
    cover = [{"wave": wave.wave, "alias": t.alias, **joins.coverage(anchor, d, ["MCSID", "CNUM"]).first().asDict()} for t, d in by_role("child")] if validate else []
    out = joins.join_roles(anchor, [(d, ["MCSID", "CNUM"], t.alias) for t, d in by_role("child")], validate=validate)
    out = joins.join_roles(out, [(d, ["MCSID"], t.alias) for t, d in by_role("family")], validate=validate)
    parents, links = by_role("parent"), by_role("link")
    if links:
        keys = reshape.union_keys([d for _, d in links], ["MCSID", "CNUM", "PNUM"])
        linked = joins.join_roles(keys, [(d, ["MCSID", "CNUM", "PNUM"], t.alias) for t, d in links], validate=validate)
        linked = joins.join_roles(linked, [(d, ["MCSID", "PNUM"], t.alias) for t, d in parents], validate=validate)
        values = [c for c in linked.columns if c not in ("MCSID", "CNUM", "PNUM")]
        if values:
            slots = reshape.pivot_slots(linked, ["MCSID", "CNUM"], project.slot_label(F.col("PNUM")), parent_slots, values, ["PNUM"])
            out = joins.join_roles(out, [(slots, ["MCSID", "CNUM"], "parents")], validate=False)
    fixed = out.select(project.child_identifier(F.col("MCSID"), F.col("CNUM")).alias("CHID"), F.lit(wave.wave).alias("wave"), "*")
    return fixed, cover


def apply_composites(df: DataFrame, composites: Sequence[Composite], wave: str) -> DataFrame:
    """Composite columns whose inputs are all there; inputs resolve like features. Others stay out."""
    made = []
    for c in composites:
        if c.waves and wave not in c.waves:
            continue
        found = project.resolve_features(df, {i: (i, None) for i in c.inputs})
        if all(found.values()):
            made.append(encode.reduce_row(df, [found[i] for i in c.inputs], c.how).alias(c.output))
    return df.select("*", *made)


def prepare_wave(wave: WaveInput, composites: Sequence[Composite] = (), **options) -> tuple[DataFrame, list[str], list[dict]]:
    """The features of one wave's subjects; names that no column resolves are tried again after the composites."""
    subjects, cover = subject_table(wave, **options)
    subjects = apply_composites(subjects, composites, wave.wave)
    out, missing = project.select_wave_features(subjects, FIXED, wave.longitudinal, wave.static, wave.wave)
    return out, missing, cover


def prepare(waves: Sequence[WaveInput], composites: Sequence[Composite] = (), *, output: str = "long_and_wide", **options) -> Prepared:
    """All waves in one plan. ``output``: long, wide or long_and_wide."""
    if output not in ("long", "wide", "long_and_wide") or not waves:
        raise InputValidationError("output must be long, wide or long_and_wide, and there must be a wave")
    if len({w.wave for w in waves}) != len(waves):
        raise InputValidationError("a wave is given twice")
    frames, unresolved, cover = [], {}, []
    for w in sorted(waves, key=lambda w: w.wave):
        df, missing, own = prepare_wave(w, composites, **options)
        frames.append(df)
        cover += own
        if missing:
            unresolved[w.wave] = missing
    both = reshape.union_by_name(frames)
    canonical = sorted({c for w in waves for c in w.longitudinal if c in both.columns})
    static = [c for c in both.columns if c not in canonical and c not in ("CHID", "wave")]
    names = sorted(w.wave for w in waves)
    return Prepared(
        both if output != "wide" else None,
        reshape.waves_to_wide(both, "CHID", "wave", names, canonical, static) if output != "long" else None,
        unresolved,
        cover,
    )


def preview(waves: Sequence[WaveInput], composites: Sequence[Composite] = ()) -> dict:
    """What a run would use, without reading any data: keys, roles, the feature matrix and composites."""
    features = sorted({c for w in waves for c in w.longitudinal})
    return {
        "keys": {r: list(k) for r, k in ROLES.items()},
        "roles": {w.wave: {r: sum(t.role == r and not t.excluded for t in w.tables) for r in ROLES} for w in waves},
        "features": {c: {w.wave: w.longitudinal[c][0] for w in waves if c in w.longitudinal} for c in features},
        "static": {w.wave: sorted(w.static) for w in waves},
        "composites": [{"output": c.output, "how": c.how, "inputs": list(c.inputs)} for c in composites],
    }
