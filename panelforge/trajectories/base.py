"""What all trajectory builders share: series, results, saved models, the registry (T1, T6-T8, IO16)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError, OperationNotFoundError
from panelforge.functions.exprs import numeric, quoted
from panelforge.operators.project import numeric_columns, require_columns


@dataclass
class TrajectoryResult:
    """``assignments`` (subject_id, trajectory_id, trajectory_name, class_0.. for mixtures) and small tables as lists of dicts."""

    assignments: DataFrame
    centroids: list[dict] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)
    diagnostics: list[dict] = field(default_factory=list)


def trajectory_names(k: int, names: Sequence[str] | None = None) -> list[str]:
    if names is not None and len(names) != k:
        raise InputValidationError(f"{k} trajectories need {k} names")
    return list(names) if names else [f"cluster_{i}" for i in range(k)]


def subject_series(df: DataFrame, id_col: str, time_col: str, value_cols: Sequence[str], *, complete: bool = True) -> DataFrame:
    """(subject_id, times, series): one row per subject, repeated (subject, time) rows averaged, times ascending.

    Null subjects and times are left out. With ``complete`` a missing value, or a subject without some time of the panel, is an error; else
    a column ``is_complete`` tells whether any value of the subject is missing.
    """
    require_columns(df, [id_col, time_col, *value_cols])
    rows = df.select(F.col(quoted(id_col)).alias("subject_id"), numeric(df, time_col).alias("t"), *(numeric(df, v).alias(f"v{i}") for i, v in enumerate(value_cols)))
    rows = rows.filter("subject_id IS NOT NULL AND t IS NOT NULL")
    n = len(value_cols)
    # a subject whose any row lacks a value is incomplete, even if another row of that time has it
    cells = rows.groupBy("subject_id", "t").agg(*(F.avg(f"v{i}").alias(f"v{i}") for i in range(n)), *(F.count_if(F.col(f"v{i}").isNull()).alias(f"m{i}") for i in range(n)))
    lacks = sum((F.col(f"m{i}") for i in range(1, n)), F.col("m0"))
    packed = cells.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("t", F.array(*(f"v{i}" for i in range(n))).alias("v")))).alias("x"), (F.sum(lacks) == 0).alias("is_complete"))
    out = packed.select("subject_id", F.col("x.t").alias("times"), F.col("x.v").alias("series"), "is_complete")
    if not complete:
        return out
    times = cells.agg(F.count_distinct("t")).first()[0]
    bad = out.filter(~F.col("is_complete") | (F.size("times") != times)).limit(1).count()
    if bad:
        raise InputValidationError("every subject needs a value of every outcome at every time")
    return out.drop("is_complete")


def class_sizes_warning(result: TrajectoryResult, least: float = 0.03) -> list[str]:
    """A warning for each class with a smaller share of subjects than ``least``."""
    rows = result.assignments.filter("trajectory_id IS NOT NULL").groupBy("trajectory_name").count().collect()
    total = sum(r["count"] for r in rows) or 1
    return [f"{r['trajectory_name']} holds {r['count'] / total:.1%} of the subjects" for r in sorted(rows, key=lambda r: r[0]) if r["count"] / total < least]


def save_model(path: str, builder: str, settings: Mapping, parameters: Mapping) -> str:
    """Settings and fitted parameters as JSON; nothing in it is code."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"builder": builder, "settings": dict(settings), "parameters": dict(parameters)}))
    return path


def load_model(path: str) -> dict:
    try:
        model = json.loads(Path(path).read_text())
        return {k: model[k] for k in ("builder", "settings", "parameters")}
    except (OSError, ValueError, KeyError) as e:
        raise InputValidationError(f"{path} is no saved trajectory model: {e}") from e


def builders() -> dict[str, Callable]:
    from panelforge.trajectories.dtw import DtwKMeans
    from panelforge.trajectories.mixture import GrowthMixture, LatentClassGrowth
    from panelforge.trajectories.spline import SplineClusters

    return {"dtw_kmeans": DtwKMeans, "lcga": LatentClassGrowth, "gmm": GrowthMixture, "clustermld": SplineClusters}


def build_trajectories(df: DataFrame, technique: str, *, id_col: str = "subject_id", time_col: str = "wave", value_cols: Sequence[str] | None = None, class_col: str | None = None, n_trajectories: int | None = 3, builder_kwargs: Mapping | None = None, save_model_path: str | None = None, input_model_path: str | None = None, refit: bool = True) -> TrajectoryResult:
    """Trajectories by a builder's name, or ``from_saved_model``.

    ``value_cols`` defaults to all numeric columns but id, time and class. Builders of one outcome take the first. A saved model is fitted
    again on the new data unless ``refit=False``, which assigns subjects under the saved parameters.
    """
    known = builders()
    saved = None
    settings = dict(builder_kwargs or {})
    if technique == "from_saved_model":
        saved = load_model(input_model_path or "")
        technique, settings = saved["builder"], {**saved["settings"], **settings}
        n_trajectories = settings.pop("n_trajectories", n_trajectories)
    if technique not in known:
        raise OperationNotFoundError(f"no trajectory builder {technique!r}; there are {', '.join(sorted(known))}")
    values = list(value_cols or numeric_columns(df, [id_col, time_col, *([class_col] if class_col else [])]))
    if not values:
        raise InputValidationError("there is no value column")
    try:
        model = known[technique](n_trajectories=n_trajectories, **settings)
    except TypeError as e:
        raise InputValidationError(f"{technique}: {e}") from e
    values = values[: model.max_value_cols] if model.max_value_cols else values
    result = model.assign(df, id_col, time_col, values, saved["parameters"]) if saved and not refit else model.fit(df, id_col, time_col, values)
    if save_model_path:
        save_model(save_model_path, technique, asdict(model), result.parameters)
    return result
