"""Cross-validated experiments, benchmarks, explanations and their files."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import quoted
from panelforge.ml import metrics as M
from panelforge.ml.estimators import LONGITUDINAL, STANDARD, FeatureGroups, Model, fit_longitudinal, fit_standard
from panelforge.ml.splits import parse_split, with_folds, with_shuffles
from panelforge.operators.project import label_codes, require_columns, scenario_names
from panelforge.operators.reshape import feature_groups as suffix_groups


@dataclass
class Experiment:
    estimator_key: str
    classes: list[str]
    fold_scores: dict[str, list[float]]
    summary: dict[str, tuple[float, float]]
    report: list[dict]
    model: Model | None = None
    files: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def prepare(df: DataFrame, target: str, features: str | Sequence[str] = "auto") -> tuple[DataFrame, list[str], list[str]]:
    """(rows with ``label`` codes and ``__row``, features, class names); rows without target are left out."""
    require_columns(df, [target])
    names = [c for c in df.columns if c != target] if isinstance(features, str) and features == "auto" else ([x.strip() for x in features.split(",")] if isinstance(features, str) else list(features))
    require_columns(df, names)
    if target in names or not names:
        raise InputValidationError("the features must not be empty or hold the target")
    rows = df.filter(F.col(quoted(target)).isNotNull())
    coded, codes = label_codes(rows, target)
    if len(codes) < 2:
        raise InputValidationError("the target needs two classes at least")
    out = coded.select(*(quoted(c) for c in names), F.col(f"{target}_code").cast("double").alias("label"))
    # rows are known by their content; a counter per content keeps repeated rows apart
    return out.withColumn("__row", F.xxhash64(*out.columns)), names, list(codes)


def parse_groups(columns: Sequence[str], mode: str = "suffix", groups: str | Sequence | None = None, suffix: str | None = None, preset: str | None = None, static: str | Sequence[str] | None = None, target: str | None = None) -> FeatureGroups:
    """Feature groups from a suffix (``_w``), the preset ``elsa`` (the same), or by hand (``a1,a2;b1,b2``, names or positions,
    -1 or blank for a missing wave). Static features default to all other columns."""
    columns = [c for c in columns if c != target]
    if mode == "manual":
        if not groups:
            raise InputValidationError("manual feature groups are missing")
        given = [g.split(",") for g in groups.split(";")] if isinstance(groups, str) else [list(g) for g in groups]
        own: list[list[str | None]] = []
        for g in given:
            row: list[str | None] = []
            for x in g:
                x = x.strip() if isinstance(x, str) else x
                if x in ("", "-1", -1):
                    row.append(None)
                elif x in columns:
                    row.append(x)
                elif str(x).lstrip("-").isdigit() and 0 <= int(x) < len(columns):
                    row.append(columns[int(x)])
                else:
                    raise InputValidationError(f"no feature {x!r}")
            own.append(row)
    else:
        if mode == "preset" and preset != "elsa":
            raise InputValidationError("the only preset is elsa")
        found = suffix_groups(columns, "_w" if mode == "preset" else suffix or "_w")
        waves = sorted({w for g in found.values() for w in g})
        own = [[g.get(w) for w in waves] for _, g in sorted(found.items())]
    flat = [c for g in own for c in g if c]
    if not own or any(sum(c is not None for c in g) < 2 for g in own):
        raise InputValidationError("a feature group needs two waves at least")
    if len(set(flat)) != len(flat):
        raise InputValidationError("a feature stands in two groups")
    longest = max(map(len, own))
    own = [g + [None] * (longest - len(g)) for g in own]
    if static is None or static == "auto":
        rest = [c for c in columns if c not in flat]
    else:
        rest = [x.strip() for x in static.split(",") if x.strip()] if isinstance(static, str) else list(static)
    return FeatureGroups(own, rest)


def cross_validate(rows: DataFrame, classes: Sequence[str], fit: Callable[[DataFrame], Model], key: str, metric_names: Sequence[str], *, folds: int = 10, split: str | float | None = None, seed: int = 42) -> Experiment:
    """Scores of each fold (or repeated hold-out), a pooled class report, and a final fit on all rows."""
    share, n = parse_split(split), len(classes)
    keyed = [c for c in rows.columns if c != "label"]
    if share is None:
        parts = cut(with_folds(rows, "label", folds, seed, *keyed))
        pieces = [(parts.filter(F.col("fold") != k).drop("fold"), parts.filter(F.col("fold") == k).drop("fold")) for k in range(folds)]
    else:
        parts = cut(with_shuffles(rows, "label", share, folds, seed, *keyed))
        inside = [F.array_contains("test_in", k) for k in range(folds)]
        pieces = [(parts.filter(~x).drop("test_in"), parts.filter(x).drop("test_in")) for x in inside]
    scores: dict[str, list[float]] = {m: [] for m in metric_names}
    pooled = np.zeros((n, n))
    for train, test in pieces:
        model = fit(train)
        told = model.score(test).select("label", "prediction", *(["probability"] if model.has_probability else []))
        told = cut(told)
        for m, v in M.evaluate(told, n, metric_names, has_probability=model.has_probability).items():
            scores[m].append(v)
        pooled += M.confusion(told, n)
    with np.errstate(all="ignore"):
        summary = {m: (float(np.nanmean(v)) if not np.isnan(v).all() else float("nan"), float(np.nanstd(v)) if not np.isnan(v).all() else float("nan")) for m, v in scores.items()}
    return Experiment(key, list(classes), scores, summary, M.report(pooled, classes), fit(rows))


def _write(e: Experiment, folder: str | None) -> Experiment:
    if not folder:
        return e
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    data = {"estimator": e.estimator_key, "classes": e.classes, "fold_scores": e.fold_scores, "summary": {k: {"mean": a, "std": b} for k, (a, b) in e.summary.items()}, "report": e.report}
    (root / "summary.json").write_text(json.dumps(data, indent=2))
    lines = [f"{e.estimator_key}", *(f"{m}: {a:.4f} +- {b:.4f}" for m, (a, b) in e.summary.items()), ""]
    lines += [f"{r['label']:<24} precision {r['precision']:.3f} recall {r['recall']:.3f} f1 {r['f1']:.3f} n {r['support']}" for r in e.report]
    (root / "report.txt").write_text("\n".join(lines))
    e.files = {"summary": str(root / "summary.json"), "report": str(root / "report.txt")}
    native = e.model.native if e.model else None
    if hasattr(native, "write"):
        native.write().overwrite().save(str(root / "model"))
        e.files["model"] = str(root / "model")
    return e


def run_standard(df: DataFrame, target: str, estimator_key: str, *, features: str | Sequence[str] = "auto", metric_keys: str | Sequence[str] = "f1_macro", cv_folds: int = 10, validation_split=None, random_seed: int = 42, hyperparameters: Mapping | None = None, multiclass_mode: str = "multiclass", output_dir: str | None = None) -> dict[str, Experiment]:
    """One experiment, or one for each class against the rest; keyed by scenario (``multiclass`` or ``traj_..._vs_rest``)."""
    if estimator_key not in STANDARD:
        raise InputValidationError(f"estimator must be one of {', '.join(sorted(STANDARD))}")
    rows, names, classes = prepare(df, target, features)
    return _scenarios(rows, classes, multiclass_mode == "one_vs_rest", lambda part, n: fit_standard(part, names, "label", n, estimator_key, random_seed, dict(hyperparameters or {})), estimator_key, M.resolve(metric_keys), cv_folds, validation_split, random_seed, output_dir)


def run_longitudinal(df: DataFrame, target: str, estimator_key: str, groups: FeatureGroups, *, metric_keys: str | Sequence[str] = "f1_macro", cv_folds: int = 10, validation_split=None, random_seed: int = 42, hyperparameters: Mapping | None = None, output_dir: str | None = None) -> dict[str, Experiment]:
    """As :func:`run_standard` with a longitudinal estimator; more than two classes go one-vs-rest."""
    if estimator_key not in LONGITUDINAL:
        raise InputValidationError(f"no longitudinal estimator {estimator_key!r}")
    rows, _, classes = prepare(df, target, groups.features)
    return _scenarios(rows, classes, len(classes) > 2, lambda part, n: fit_longitudinal(part, groups, "label", n, estimator_key, random_seed, dict(hyperparameters or {})), estimator_key, M.resolve(metric_keys), cv_folds, validation_split, random_seed, output_dir)


def _scenarios(rows: DataFrame, classes: list[str], apart: bool, fit, key: str, names: list[str], folds: int, split, seed: int, folder: str | None) -> dict[str, Experiment]:
    if not apart:
        return {"multiclass": _write(cross_validate(rows, classes, lambda p: fit(p, len(classes)), key, names, folds=folds, split=split, seed=seed), folder)}
    out = {}
    for code, (label, name) in enumerate(scenario_names(classes).items()):
        own = rows.withColumn("label", (F.col("label") == code).cast("double"))
        out[name] = _write(cross_validate(own, ["rest", label], lambda p: fit(p, 2), key, names, folds=folds, split=split, seed=seed), f"{folder}/{name}" if folder else None)
    return out


@dataclass
class Benchmark:
    ranking: list[dict]
    skipped: dict[str, str]
    experiments: dict[str, dict[str, Experiment]]


def run_benchmark(df: DataFrame, target: str, *, pool: str = "standard", groups: FeatureGroups | None = None, estimators: Sequence[str] | None = None, excluded: Sequence[str] = (), metric_keys: str | Sequence[str] = "f1_macro", output_root: str | None = None, **options) -> Benchmark:
    """All estimators of a pool (``standard``, ``longitudinal`` or ``both``) under the same folds, best mean score first.

    An estimator that fails keeps its place with every score -1.0 and is listed as skipped; means that are NaN come last.
    """
    if pool not in ("standard", "longitudinal", "both"):
        raise InputValidationError("pool must be standard, longitudinal or both")
    names = M.resolve(metric_keys)
    jobs = [("standard", k) for k in sorted(STANDARD)] if pool != "longitudinal" else []
    if pool != "standard":
        if groups is None:
            raise InputValidationError("longitudinal estimators need feature groups")
        jobs += [("longitudinal", k) for k in LONGITUDINAL]
    jobs = [(p, k) for p, k in jobs if k not in excluded and (estimators is None or k in estimators)]
    if not jobs:
        raise InputValidationError("no estimator is left")
    done, skipped, ranking = {}, {}, []
    for p, key in jobs:
        label = f"{key} [{p}-ml]" if pool == "both" else key
        folder = f"{output_root}/{key}" if output_root else None
        try:
            done[label] = run_standard(df, target, key, metric_keys=names, output_dir=folder, features=options.get("features", "auto"), **{k: v for k, v in options.items() if k != "features"}) if p == "standard" else run_longitudinal(df, target, key, groups, metric_keys=names, output_dir=folder, **{k: v for k, v in options.items() if k not in ("features", "multiclass_mode")})
            each = [e.summary[names[0]] for e in done[label].values()]
            mean, std = float(np.mean([a for a, _ in each])), float(np.mean([b for _, b in each]))
            folds = [v for e in done[label].values() for v in e.fold_scores[names[0]]]
        except InputValidationError as e:
            skipped[label] = str(e)
            mean, std, folds = -1.0, 0.0, [-1.0] * int(options.get("cv_folds", 10))
        ranking.append({"estimator_key": key, "estimator_name": label, "metric_key": names[0], "metric_keys": ",".join(names), "mean_score": mean, "std_score": std, "fold_scores": folds})
    ranking.sort(key=lambda r: (np.isnan(r["mean_score"]), -r["mean_score"] if not np.isnan(r["mean_score"]) else 0.0))
    ranking = [{"rank": i + 1, **r} for i, r in enumerate(ranking)]
    if output_root:
        from panelforge.viz.report import benchmark_html, notebook

        Path(output_root).mkdir(parents=True, exist_ok=True)
        Path(output_root, "ranking.json").write_text(json.dumps({"ranking": ranking, "skipped": skipped}, indent=2))
        Path(output_root, "ranking.html").write_text(benchmark_html(ranking, skipped))
        Path(output_root, "benchmark.ipynb").write_text(notebook("Benchmark", [f"from panelforge.ml.experiment import run_benchmark\nresult = run_benchmark(df, {target!r}, pool={pool!r}, metric_keys={names!r})\nresult.ranking"]))
    return Benchmark(ranking, skipped, done)


def shapley_importance(df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], *, class_index: int | None = None, rows: int = 200, background: int = 100, permutations: int = 10, seed: int = 42) -> DataFrame:
    """(feature, mean_abs_shap): permutation-sampled Shapley values of a fitted model's class score.

    ``rows`` rows are explained against ``background`` rows, both taken by a hash: an explanation of a model, bounded by design.
    All (row, permutation, position) variants are scored in one distributed pass.
    """
    spark, names = df.sparkSession, list(features)
    h = F.xxhash64(*(F.col(quoted(c)) for c in names), F.lit(seed))
    taken = cut(df.select(*names).withColumn("__h", h).orderBy("__h").limit(rows + background)).orderBy("__h").collect()
    if not taken:
        return spark.createDataFrame([], "feature string, mean_abs_shap double")
    explain, base = taken[:rows], taken[rows:] or taken
    rng, variants = np.random.default_rng(seed), []
    for i, r in enumerate(explain):
        for p in range(permutations):
            order = rng.permutation(len(names))
            now = list(base[int(rng.integers(len(base)))][: len(names)])
            variants.append((i, p, 0, "", *now))
            for step, f in enumerate(order):
                now[f] = r[int(f)]
                variants.append((i, p, step + 1, names[f], *now))
    kinds = dict(df.dtypes)
    schema = "row int, perm int, step int, feature string, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    scored = score(spark.createDataFrame(variants, schema))
    if "probability" in scored.columns:
        k = class_index if class_index is not None else -1
        value = F.element_at("probability", k + 1 if k >= 0 else -1)
    else:
        value = F.col("prediction")
    from pyspark.sql import Window

    w = Window.partitionBy("row", "perm").orderBy("step")
    steps = scored.select("row", "perm", "step", "feature", value.alias("v")).withColumn("gain", F.col("v") - F.lag("v").over(w)).filter("step > 0")
    each = steps.groupBy("row", "feature").agg(F.avg("gain").alias("shap"))
    return each.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def model_preset(*_args, **_kwargs):
    """The modelling preset is announced but not available, as in the engine this one stands in for."""
    raise InputValidationError("this preset is incoming and not available yet")
