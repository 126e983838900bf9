"""Static HTML and notebooks from small tables (V1-V6, M18): Spark aggregates, the driver only draws."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.functions.exprs import numeric, quoted
from panelforge.operators.aggregate import class_sizes, class_time_profile, mean_curves, sample_per_class
from panelforge.operators.clean import profile_columns, time_axis
from panelforge.operators.project import numeric_columns, require_columns
from panelforge.operators.ranks import column_quantiles

COLOURS = ("#3366aa", "#cc6633", "#449966", "#aa4488", "#888833", "#338899", "#775599", "#aa7744")


def page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px;text-align:right}}</style><h1>{html.escape(title)}</h1>{body}"


def html_table(rows: Sequence[dict]) -> str:
    if not rows:
        return "<p>no rows</p>"
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in rows[0])
    cell = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def line_chart(series: dict[str, list[tuple[float, float]]], bands: dict[str, list[tuple[float, float, float]]] | None = None, thin: dict[str, list[list[tuple[float, float]]]] | None = None, width: int = 720, height: int = 400) -> str:
    """An SVG of named lines, optional bands (x, low, high) and thin lines behind them."""
    points = [p for s in series.values() for p in s] + [p for g in (thin or {}).values() for s in g for p in s] + [(x, y) for b in (bands or {}).values() for x, lo, hi in b for y in (lo, hi)]
    if not points:
        return "<p>nothing to draw</p>"
    x0, x1, y0, y1 = min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points)
    at = lambda x, y: f"{40 + (x - x0) / ((x1 - x0) or 1) * (width - 60):.1f},{height - 30 - (y - y0) / ((y1 - y0) or 1) * (height - 50):.1f}"
    out = []
    for i, name in enumerate(series):
        colour = COLOURS[i % len(COLOURS)]
        for s in (thin or {}).get(name, []):
            out.append(f"<polyline fill='none' stroke='{colour}' stroke-opacity='.2' points='{' '.join(at(*p) for p in s)}'/>")
        if bands and bands.get(name):
            b = bands[name]
            out.append(f"<polygon fill='{colour}' fill-opacity='.15' points='{' '.join([at(x, lo) for x, lo, _ in b] + [at(x, hi) for x, _, hi in reversed(b)])}'/>")
        out.append(f"<polyline fill='none' stroke='{colour}' stroke-width='2' points='{' '.join(at(*p) for p in series[name])}'/>")
        out.append(f"<text x='50' y='{18 + 16 * i}' fill='{colour}'>{html.escape(name)}</text>")
    return f"<svg width='{width}' height='{height}'>{''.join(out)}<text x='5' y='{height - 30}'>{y0:.3g}</text><text x='5' y='20'>{y1:.3g}</text></svg>"


def show_table(df: DataFrame, title: str = "Table report") -> str:
    """HTML: a profile of every column, quartiles of numbers and the first rows."""
    profile = [r.asDict() for r in profile_columns(df).orderBy("column_name").collect()]
    numbers = numeric_columns(df)
    stats = []
    if numbers:
        names = ("min", "q25", "median", "q75", "max")
        found = {r["column"]: r[1:] for r in column_quantiles(df, numbers, (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
        stats = [{"column": c, **dict(zip(names, found.get(c, [None] * 5)))} for c in numbers]
    first = [r.asDict() for r in df.limit(10).collect()]
    return page(title, "<h2>Columns</h2>" + html_table(profile) + "<h2>Numbers</h2>" + html_table(stats) + "<h2>First rows</h2>" + html_table(first))


def _prepared(df: DataFrame, id_col: str, time_col: str, value_col: str, trajectory: str, name: str | None) -> DataFrame:
    require_columns(df, [id_col, time_col, value_col, trajectory])
    label = F.col(quoted(name)) if name and name in df.columns else F.col(quoted(trajectory)).cast("string")
    time = time_axis(df, time_col)
    out = df.select(F.col(quoted(id_col)).alias("subject_id"), (time.cast("double") if time_col else time).alias("time"), numeric(df, value_col).alias("value"), F.concat_ws(" ", F.col(quoted(trajectory)).cast("string"), label.cast("string")).alias("trajectory"), F.col(quoted(trajectory)).alias("tid"))
    out = out.filter("tid IS NOT NULL AND time IS NOT NULL AND value IS NOT NULL").drop("tid")
    if out.limit(1).count() == 0:
        raise InputValidationError("there is nothing to draw")
    return out


def _in_class_order(names: Sequence[str]) -> list[str]:
    """Numeric ids by number, then the others by name."""

    def key(n: str):
        first = n.split(" ")[0]
        return (0, float(first), n) if first.replace(".", "", 1).lstrip("-").isdigit() else (1, 0.0, n)

    return sorted(names, key=key)


def mean_profiles(df: DataFrame, *, id_col: str = "subject_id", time_col: str = "wave", value_col: str = "depressive_score", trajectory_col: str = "trajectory_id", trajectory_name_col: str | None = "trajectory_name", show_error_band: bool = True, band_metric: str = "sem", sample_per_trajectory: int = 0, random_state: int = 42, title: str = "Mean Profiles") -> str:
    if band_metric not in ("sem", "std"):
        raise InputValidationError("band_metric must be sem or std")
    own = _prepared(df, id_col, time_col, value_col, trajectory_col, trajectory_name_col)
    rows = [r.asDict() for r in class_time_profile(own, "trajectory", "time", "value").orderBy("trajectory", "time").collect()]
    names = _in_class_order(list({r["trajectory"] for r in rows}))
    lines = {n: [(r["time"], r["mean"]) for r in rows if r["trajectory"] == n] for n in names}
    bands = {n: [(r["time"], r["mean"] - r[band_metric], r["mean"] + r[band_metric]) for r in rows if r["trajectory"] == n] for n in names} if show_error_band else None
    return page(title, line_chart(lines, bands, _sampled(own, sample_per_trajectory, random_state)) + html_table(rows))


ALL_CURVES = 100_000


def class_spaghetti(df: DataFrame, *, id_col: str = "subject_id", time_col: str = "wave", value_col: str = "depressive_score", trajectory_col: str = "trajectory_id", trajectory_name_col: str | None = "trajectory_name", sample_per_trajectory: int = 100, show_mean_profile: bool = True, random_state: int = 42, title: str = "Class Spaghetti") -> str:
    own = _prepared(df, id_col, time_col, value_col, trajectory_col, trajectory_name_col)
    rows = [r.asDict() for r in class_time_profile(own, "trajectory", "time", "value").orderBy("trajectory", "time").collect()]
    names = _in_class_order(list({r["trajectory"] for r in rows}))
    # 0 draws every curve; a page holds them all, so more than ALL_CURVES are refused
    if not sample_per_trajectory and own.select("subject_id").distinct().limit(ALL_CURVES + 1).count() > ALL_CURVES:
        raise InputValidationError(f"more than {ALL_CURVES} curves; give sample_per_trajectory")
    thin = _sampled(own, sample_per_trajectory or ALL_CURVES, random_state)
    return page(title, "".join(f"<h2>{html.escape(n)}</h2>" + line_chart({n: [(r["time"], r["mean"]) for r in rows if r["trajectory"] == n] if show_mean_profile else []}, None, {n: thin.get(n, [])}) for n in names))


def _sampled(own: DataFrame, n: int, seed: int) -> dict[str, list[list[tuple[float, float]]]]:
    if not n:
        return {}
    chosen = sample_per_class(own, "subject_id", "trajectory", n, seed)
    rows = mean_curves(own.join(chosen.select("subject_id").distinct(), "subject_id", "left_semi").select("subject_id", "time", "value"), "subject_id", "time", ["value"])
    out: dict[str, list[list[tuple[float, float]]]] = {}
    curves = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("c")).join(chosen, "subject_id")
    for r in curves.collect():
        out.setdefault(r["trajectory"], []).append([(p["time"], p["value"]) for p in r["c"]])
    return out


def trajectory_sizes(df: DataFrame, *, id_col: str = "subject_id", trajectory_col: str = "trajectory_id", trajectory_name_col: str | None = "trajectory_name", title: str = "Trajectory Sizes") -> str:
    rows = [r.asDict() for r in class_sizes(df, id_col, trajectory_col).orderBy("trajectory").collect()]
    if not rows:
        raise InputValidationError("there is nothing to draw")
    top = max(r["n_subjects"] for r in rows)
    bars = "".join(f"<div>{html.escape(str(r['trajectory']))} <span style='display:inline-block;background:{COLOURS[i % len(COLOURS)]};height:12px;width:{400 * r['n_subjects'] / top:.0f}px'></span> {r['n_subjects']} ({r['share']:.1%})</div>" for i, r in enumerate(rows))
    return page(title, bars)


def benchmark_html(ranking: Sequence[dict], skipped: dict[str, str]) -> str:
    return page("Benchmark", html_table([{k: v for k, v in r.items() if k != "fold_scores"} for r in ranking]) + "<h2>Skipped</h2>" + html_table([{"estimator": k, "reason": v} for k, v in skipped.items()]))


def notebook(title: str, cells: Sequence[str]) -> str:
    """A notebook file with a title and code cells."""
    code = [{"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": c.splitlines(keepends=True)} for c in cells]
    return json.dumps({"cells": [{"cell_type": "markdown", "metadata": {}, "source": [f"# {title}"]}, *code], "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)
