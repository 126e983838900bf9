"""One JSON request on stdin, one JSON response on stdout (IO18): ``python -m panelforge.bridge.runner``."""

from __future__ import annotations

import contextlib
import io
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.bridge.catalog import CATALOG, Registry, with_defaults
from panelforge.core.errors import InputValidationError, LibraryError, OperationNotFoundError

PRESETS = {"data_preparation": ["prepare"], "data_preprocessing": ["preprocess"], "machine_learning": ["model"]}


class Session:
    """A Spark session made at the first use."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return self._spark


def _read(s: Session, path: str) -> DataFrame:
    from panelforge.sources import files

    if not path:
        raise InputValidationError("input_path is needed")
    suffix = path.rsplit(".", 1)[-1].lower()
    reader = {"csv": files.read_csv, "parquet": files.read_parquet, "dta": files.read_stata}.get(suffix)
    if reader is None:
        raise InputValidationError(f"cannot read {path}")
    return reader(s.spark, path)


def _write(df: DataFrame, path: str, overwrite: bool = True) -> dict:
    from panelforge.sources import files

    if not path:
        raise InputValidationError("output_path is needed")
    if path.endswith(".parquet"):
        files.write_parquet(df, path, overwrite=overwrite)
    else:
        files.write_csv(df, path, overwrite=overwrite)
    return {"output_path": path, "columns": df.columns}


def _jobs(s: Session) -> dict[str, Callable[[str, dict], dict]]:
    """Section -> handler(technique, parameters with defaults)."""
    from panelforge.ml import estimators, experiment, metrics
    from panelforge.operators import aggregate, clean, impute, joins, project, reshape
    from panelforge.sources import files, synthetic
    from panelforge.trajectories.base import build_trajectories
    from panelforge.viz import report

    def generate(t: str, p: dict) -> dict:
        out = p.pop("output_path")
        return _write(synthetic.generate(s.spark, t, **{k: v for k, v in p.items() if v is not None}), out)

    def convert(t: str, p: dict) -> dict:
        done = files.convert(s.spark, t, **p)
        return {"converted": done.converted, "failed": done.failed}

    def build(t: str, p: dict) -> dict:
        r = build_trajectories(
            _read(s, p["input_path"]), t, id_col=p["id_col"], time_col=p["time_col"], value_cols=p["value_cols"], class_col=p["class_col"] or None, n_trajectories=p["n_trajectories"],
            builder_kwargs=json.loads(p["builder_kwargs_json"]), save_model_path=p["save_model_path"] or None, input_model_path=p.get("input_model_path"),
        )
        return {**_write(r.assignments, p["output_path"]), "diagnostics": r.diagnostics, "centroids": r.centroids}

    def combine(t: str, p: dict) -> dict:
        data, traj = _read(s, p["input_original_data_path"]), _read(s, p["input_trajectories_data_path"])
        out = joins.combine_with_trajectories(data, traj, p["original_id_col"], p["trajectory_id_col"], columns=p["trajectory_columns"], drop=p["drop_columns"], how=p["merge_type"])
        return _write(out, p["output_path"])

    def clean_up(t: str, p: dict) -> dict:
        kw = {k: p[k] for k in ("drop_null_fraction", "drop_if_constant", "drop_if_unique", "cast_to_str", "numeric_to_float32")}
        return _write(clean.clean_types(_read(s, p["input_path"]), datetime_format=p["datetime_format"] or None, **kw), p["output_path"])

    def fill(t: str, p: dict) -> dict:
        df = _read(s, p["input_path"])
        kw = {k: v for k, v in p.items() if k not in ("input_path", "output_path")}
        out = impute.impute(df, t, **kw)
        return {**_write(out, p["output_path"]), **impute.imputation_report(df, out).first().asDict()}

    def harmonise(t: str, p: dict) -> dict:
        out, mapping = clean.harmonise_categories(_read(s, p["input_path"]), p["target_columns"] or [], p["n_clusters"])
        if p["save_mapping"]:
            _write(mapping.orderBy("column", "original"), p["mapping_path"])
        return _write(out, p["output_path"])

    def draw(t: str, p: dict) -> dict:
        out, df = p.pop("output_html"), _read(s, p.pop("input_path"))
        return {"output_html": files.write_text(report.show_table(df) if t == "show_table" else getattr(report, t)(df, **p), out)}

    def cross(t: str, p: dict) -> dict:
        out = aggregate.aggregate_to_cross_section(_read(s, p["input_path"]), p["subject_id_col"], numeric_cols=p["numeric_columns"] or None, categorical_cols=p["categorical_columns"], numeric_agg=p["numeric_agg"], categorical_agg=p["categorical_agg"], order=p["order_column"])
        return _write(out, p["output_path"], overwrite=False)

    def remove(t: str, p: dict) -> dict:
        path = p["output_path"] or p["input_path"].rsplit(".", 1)[0] + "_columns_removed.csv"
        return _write(project.remove_columns(_read(s, p["input_path"]), p["columns"] or []), path, overwrite=False)

    def rename(t: str, p: dict) -> dict:
        return _write(project.rename_feature(_read(s, p["input_path"]), p["feature_name"], p["new_feature_name"] or ""), p["output_path"], overwrite=False)

    def pivot(t: str, p: dict) -> dict:
        out = reshape.pivot_long_to_wide(_read(s, p["input_path"]), p["id_cols"], p["time_col"], longitudinal=p["longitudinal_columns"], static=p["non_longitudinal_columns"], time_label=p["time_label"], separator=p["separator"])
        return _write(out, p["output_path"], overwrite=False)

    def groups_of(df: DataFrame, p: dict) -> estimators.FeatureGroups:
        return experiment.parse_groups(df.columns, p["feature_groups_mode"], p["feature_groups"], p["feature_groups_suffix"], p["feature_groups_preset"], p["non_longitudinal_features"] if p["non_longitudinal_mode"] == "manual" else None, p["target_column"])

    def learn(section: str) -> Callable:
        def run(t: str, p: dict) -> dict:
            long, both = "longitudinal" in section, section == "bench_standard_and_longitudinal_ml"
            if t == "list_estimators":
                return {"estimators": ([] if long and not both else sorted(estimators.STANDARD)) + (list(estimators.LONGITUDINAL) if long else [])}
            if t == "list_metrics":
                return {"metrics": list(metrics.METRICS), "aliases": metrics.ALIASES}
            df = _read(s, p["input_path"])
            common = {"metric_keys": p["metric_keys"], "cv_folds": p["cv_folds"], "validation_split": p["validation_split"], "random_seed": p["random_seed"]}
            groups = groups_of(df, p) if long else None
            if t == "run_benchmark":
                out = [x.strip() for x in p["excluded_estimators"].split(",") if x.strip() and x.strip() != "none"]
                b = experiment.run_benchmark(df, p["target_column"], pool="both" if both else "longitudinal" if long else "standard", groups=groups, excluded=out, output_root=p["output_root_dir"], features=p["feature_columns"], **common)
                return {"ranking": b.ranking, "skipped": b.skipped}
            hyper = json.loads(p["hyperparameters_json"]) if isinstance(p["hyperparameters_json"], str) else p["hyperparameters_json"]
            if long:
                done = experiment.run_longitudinal(df, p["target_column"], p["estimator_key"], groups, hyperparameters=hyper, output_dir=p["output_dir"], **common)
            else:
                done = experiment.run_standard(df, p["target_column"], p["estimator_key"], features=p["feature_columns"], hyperparameters=hyper, multiclass_mode=p["multiclass_mode"], output_dir=p["output_dir"], **common)
            return {"scenarios": {k: {"summary": e.summary, "report": e.report, "files": e.files} for k, e in done.items()}}

        return run

    def explain(t: str, p: dict) -> dict:
        from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, LinearSVCModel, LogisticRegressionModel, RandomForestClassificationModel
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.sql import functions as F

        model = None
        for cls in (RandomForestClassificationModel, DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, LinearSVCModel):
            try:
                model = cls.load(p["model_path"])
                break
            except Exception:  # another class wrote it
                continue
        if model is None:
            raise InputValidationError(f"{p['model_path']} holds no model that can be explained")
        df = _read(s, p["input_path"])
        names = [c for c in df.columns if c != p["target_column"]] if p["feature_columns"] == "auto" else [x.strip() for x in p["feature_columns"].split(",")]
        columns = estimators.Preprocessor(names).fit(df).columns()

        def score(rows: DataFrame) -> DataFrame:
            out = model.transform(rows.withColumn("__x", array_to_vector(F.array(*(c for _, c in columns)))).withColumnRenamed("__x", model.getFeaturesCol()))
            return out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out

        k = None if p["class_index"] in ("auto", None) else int(p["class_index"])
        rows = [r.asDict() for r in experiment.shapley_importance(df, names, score, class_index=k, rows=p["max_rows_to_explain"], background=p["background_rows"]).orderBy(F.desc("mean_abs_shap"), "feature").collect()]
        if p["output_dir"]:
            files.write_json(rows, p["output_dir"] + "/shap_importance.json")
            files.write_text(report.page("Feature importance", report.html_table(rows[:20])), p["output_dir"] + "/shap_report.html")
        return {"importance": rows}

    jobs = {
        "synthetic_data_generation": generate, "data_conversion": convert, "build_trajectories": build, "combine_dataset_with_trajectories": combine, "clean_dataset": clean_up, "missing_imputation": fill,
        "harmonise_categories": harmonise, "show_table": draw, "aggregate_long_to_cross_sectional": cross, "remove_columns": remove, "rename_feature": rename, "pivot_long_to_wide": pivot, "trajectories_viz": draw, "shap_analysis": explain,
    }
    return jobs | {x: learn(x) for x in CATALOG if x.endswith("_ml") or x.endswith("machine_learning")}


def registry(spark: SparkSession | None = None) -> Registry:
    """All operations: ``core.catalog``, ``{section}.catalog`` and ``{section}.run`` (technique and params), presets."""
    from panelforge.ml.experiment import model_preset
    from panelforge.plans import prepare

    r, s = Registry(), Session(spark)
    r.add("core.catalog", lambda p: {"sections": CATALOG, "presets": PRESETS})
    for section in CATALOG:

        def run(p: dict, section: str = section) -> dict:
            technique = p.pop("technique", None) or (next(iter(CATALOG[section])) if len(CATALOG[section]) == 1 else None)
            if technique is None:
                raise InputValidationError(f"a technique is needed: {', '.join(CATALOG[section])}")
            return _jobs(s)[section](technique, with_defaults(section, technique, p.get("params", p)))

        r.add(f"{section}.catalog", lambda p, section=section: CATALOG[section])
        r.add(f"{section}.run", run)
    r.add("remove_columns", lambda p: _jobs(s)["remove_columns"]("remove_columns", with_defaults("remove_columns", "remove_columns", p)))
    for phase in PRESETS:
        r.add(f"{phase}.presets.catalog", lambda p, phase=phase: {"presets": PRESETS[phase]})
    r.add("presets.prepare.profile", lambda p: {"keys": {k: list(v) for k, v in prepare.ROLES.items()}, "outputs": ["long", "wide", "long_and_wide"]})
    r.add("presets.prepare.run", lambda p: _run_prepare(s, p))
    r.add("presets.preprocess.profile", lambda p: {"stages": ["target_rows", "structural", "sentinels", "leakage", "correlation", "encoding"]})
    r.add("presets.preprocess.run", lambda p: _run_preprocess(s, p))
    r.add("presets.model.run", lambda p: model_preset())
    return r


def _run_prepare(s: Session, p: dict) -> dict:
    """Waves as JSON: ``{wave, tables: [{role, alias, path, cnum_source, pnum_source}], longitudinal, static}``."""
    from panelforge.plans import prepare as P

    waves = [
        P.WaveInput(w["wave"], [P.SourceTable(t["role"], t["alias"], _read(s, t["path"]), t.get("cnum_source"), t.get("pnum_source"), t.get("excluded", False)) for t in w["tables"]], {k: tuple(v) for k, v in w.get("longitudinal", {}).items()}, {k: tuple(v) for k, v in w.get("static", {}).items()})
        for w in p["waves"]
    ]
    composites = [P.Composite(c["output"], tuple(c["inputs"]), c["how"], tuple(c.get("waves", ()))) for c in p.get("composites", [])]
    done = P.prepare(waves, composites, output=p.get("output", "long_and_wide"))
    written = {k: _write(df, f"{p['output_dir']}/{k}.parquet", overwrite=False)["output_path"] for k, df in (("long", done.long), ("wide", done.wide)) if df is not None}
    return {"outputs": written, "unresolved": done.unresolved, "coverage": done.coverage}


def _run_preprocess(s: Session, p: dict) -> dict:
    from panelforge.plans import preprocess as P

    policy = dict(p["policy"])
    policy["encodings"] = {k: P.RootPolicy(**{a: ({float(x): y for x, y in b.items()} if a == "mapping" else b) for a, b in v.items()}) for k, v in policy.get("encodings", {}).items()}
    done = P.preprocess(_read(s, p["input_path"]), P.Policy(**policy))
    out = _write(done.data, p["output_path"], overwrite=False)
    return {**out, "audits": P.write_audits(done, p["audit_dir"]) if p.get("audit_dir") else [], "summary": done.summary}


def main(argv: list[str] | None = None) -> int:
    """Exit code 0: done; 1: failed; 2: the request cannot be read; 3: no such operation."""
    if "--ping" in (argv if argv is not None else sys.argv[1:]):
        print(json.dumps({"ok": True, "result": "pong"}))
        return 0
    try:
        request = json.loads(sys.stdin.read())
        name, params = request["operation"], request.get("params") or {}
        if not isinstance(params, dict):
            raise ValueError("params must be an object")
    except (ValueError, KeyError, TypeError) as e:
        print(json.dumps({"ok": False, "error": f"bad request: {e}"}))
        return 2
    said = io.StringIO()
    try:
        with contextlib.redirect_stdout(said):
            result = registry().run(name, params)
    except OperationNotFoundError as e:
        print(json.dumps({"ok": False, "error": str(e)}))
        return 3
    except (LibraryError, KeyError, ValueError) as e:
        print(json.dumps({"ok": False, "error": str(e)}))
        return 1
    print(json.dumps({"ok": True, "result": result}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
