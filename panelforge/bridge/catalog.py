"""Techniques with their parameters and defaults, and the registry of operations (section 2.12)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from panelforge.core.errors import InputValidationError, OperationNotFoundError

_OUT = {"input_path": None, "output_path": None}
_BUILD = {**_OUT, "output_path": "build_trajectories_output.csv", "id_col": "subject_id", "time_col": "wave", "value_cols": ["depressive_score"], "class_col": "", "n_trajectories": 3, "builder_kwargs_json": "{}", "save_model_path": ""}
_CONVERT = {"run_mode": "single", "input_path": None, "output_path": None, "input_folder": None, "output_folder": None, "include_subfolders": False}
_CV = {"input_path": None, "target_column": "target", "feature_columns": "auto", "metric_keys": "f1_macro", "cv_folds": 10, "validation_split": "auto", "random_seed": 42}
_GROUPS = {"feature_groups_mode": "manual", "feature_groups": None, "feature_groups_preset": None, "feature_groups_suffix": None, "non_longitudinal_mode": "auto", "non_longitudinal_features": None}
_RUN = {"estimator_key": None, "output_dir": None, "hyperparameters_json": "{}"}
_BENCH = {"excluded_estimators": "none", "output_root_dir": None}
_VIZ = {"input_path": None, "id_col": "subject_id", "trajectory_col": "trajectory_id", "trajectory_name_col": "trajectory_name"}
_CURVE = {**_VIZ, "time_col": "wave", "value_col": "depressive_score", "random_state": 42}
_LIST = {"list_estimators": {}, "list_metrics": {}}

#: Section -> technique -> parameter defaults; None means that there is no default.
CATALOG: dict[str, dict[str, dict]] = {
    "synthetic_data_generation": {
        "trend_patterns": {"output_path": "synthetic_waves.csv", "n_samples": 500, "n_waves": 4, "random_state": 42, "feature_cols": ["depressive_score"], "spec_mode": "default", "custom_class_specs_json": None},
        "event_shock_recovery": {"output_path": "synthetic_event_shock.csv", "n_samples": 500, "n_waves": 6, "random_state": 42, "feature_cols": ["depressive_score"], "shock_wave": 3, "shock_mean": 4.0, "recovery_rate": 0.8, "noise_sd": 1.0},
        "piecewise_changepoint": {"output_path": "synthetic_piecewise.csv", "n_samples": 500, "n_waves": 6, "random_state": 42, "feature_cols": ["depressive_score"], "changepoint_wave": 3, "noise_sd": 1.0, "pre_slope_sd": 0.5, "post_slope_sd": 0.5},
        "missing-data-scenarios": {"output_path": "synthetic_missing_data_scenarios.csv", "n_samples": 500, "n_waves": 6, "random_state": 42, "feature_cols": ["depressive_score", "anxiety_score", "sleep_score"], "mechanism": "mixed", "missing_rate": 0.2, "dropout_rate": 0.25, "mar_strength": 1.25},
        "harmonisation-challenge": {"output_path": "synthetic_harmonisation_challenge.csv", "n_samples": 450, "n_waves": 5, "random_state": 42, "feature_cols": ["depressive_score", "anxiety_score"], "noise_rate": 0.35, "missing_label_rate": 0.03, "include_canonical_columns": True},
    },
    "data_conversion": {k: dict(_CONVERT) for k in ("csv_to_parquet", "csv_to_stata", "parquet_to_csv", "parquet_to_stata", "stata_to_csv", "stata_to_parquet")},
    "build_trajectories": {**{k: dict(_BUILD) for k in ("lcga", "gmm", "dtw_kmeans", "clustermld")}, "from_saved_model": {"input_model_path": None, **_BUILD, "output_path": "loaded_model_trajectories.csv"}},
    "combine_dataset_with_trajectories": {"combine_dataset": {"input_original_data_path": None, "input_trajectories_data_path": None, "output_path": "dataset_with_trajectories.csv", "original_id_col": "subject_id", "trajectory_id_col": "subject_id", "trajectory_columns": [], "drop_columns": [], "merge_type": "left"}},
    "clean_dataset": {"clean_dataset": {**_OUT, "output_path": "cleaned_dataset.csv", "drop_null_fraction": 1.0, "drop_if_constant": False, "drop_if_unique": False, "datetime_format": "", "cast_to_str": False, "numeric_to_float32": False}},
    "missing_imputation": {
        **{k: {**_OUT, "output_path": "imputed_dataset.csv"} for k in ("mean_imputation", "median_imputation", "most_frequent_imputation")},
        "constant_imputation": {**_OUT, "output_path": "imputed_dataset.csv", "fill_value": None},
        "mice_imputation": {**_OUT, "output_path": "imputed_dataset.csv", "iterations": 5, "num_datasets": 1, "dataset_index": 0, "mean_match_candidates": 5, "random_state": 42},
    },
    "harmonise_categories": {"harmonise_categories": {**_OUT, "output_path": "harmonised_dataset.csv", "target_columns": None, "n_clusters": None, "save_mapping": True, "mapping_path": "harmonisation_mapping.csv"}},
    "show_table": {"show_table": {"input_path": None, "output_html": "table_report.html"}},
    "aggregate_long_to_cross_sectional": {"aggregate_long_to_cross_sectional": {**_OUT, "output_path": "cross_sectional_dataset.csv", "subject_id_col": "subject_id", "numeric_columns": [], "categorical_columns": [], "numeric_agg": "mean", "categorical_agg": "mode", "order_column": None}},
    "remove_columns": {"remove_columns": {**_OUT, "columns": None}},
    "rename_feature": {"rename_feature": {**_OUT, "output_path": "feature_renamed_dataset.csv", "feature_name": None, "new_feature_name": None}},
    "pivot_long_to_wide": {"pivot_long_to_wide": {**_OUT, "output_path": "wide_format_dataset.csv", "id_cols": ["subject_id"], "time_col": "wave", "longitudinal_columns": [], "non_longitudinal_columns": [], "time_label": "t", "separator": "_"}},
    "trajectories_viz": {
        "mean_profiles": {**_CURVE, "output_html": "mean_profiles_trajectories_viz.html", "title": "Mean Profiles", "show_error_band": True, "band_metric": "sem", "sample_per_trajectory": 0},
        "class_spaghetti": {**_CURVE, "output_html": "class_spaghetti_trajectories_viz.html", "title": "Class Spaghetti", "sample_per_trajectory": 100, "show_mean_profile": True},
        "trajectory_sizes": {**_VIZ, "output_html": "trajectory_sizes_trajectories_viz.html", "title": "Trajectory Sizes"},
    },
    "standard_machine_learning": {"run_experiment": {**_CV, **_RUN, "multiclass_mode": "multiclass"}, **_LIST},
    "longitudinal_machine_learning": {"run_experiment": {**_CV, **_GROUPS, **_RUN}, **_LIST},
    "benchmark_standard_ml": {"run_benchmark": {**_CV, **_BENCH}, **_LIST},
    "benchmark_longitudinal_ml": {"run_benchmark": {**_CV, **_GROUPS, **_BENCH}, **_LIST},
    "bench_standard_and_longitudinal_ml": {"run_benchmark": {**_CV, **_GROUPS, **_BENCH}, **_LIST},
    "shap_analysis": {"run_analysis": {"model_path": None, "input_path": None, "target_column": "none", "feature_columns": "auto", "max_rows_to_explain": 200, "background_rows": 100, "class_index": "auto", "output_dir": None}},
}


def absent(value) -> bool:
    """None, blank text and an empty list count as not given."""
    return value is None or value == [] or (isinstance(value, str) and not value.strip())


def with_defaults(section: str, technique: str, params: Mapping) -> dict:
    """Parameters over the technique's defaults; unknown names are errors."""
    if section not in CATALOG or technique not in CATALOG[section]:
        raise OperationNotFoundError(f"no technique {technique!r} in {section!r}")
    defaults = CATALOG[section][technique]
    unknown = sorted(set(params) - set(defaults) - {"builder_kwargs"})
    if unknown:
        raise InputValidationError(f"{technique} takes no {', '.join(unknown)}")
    return {**defaults, **{k: v for k, v in params.items() if not absent(v)}}


class Registry:
    """Operations by name."""

    def __init__(self):
        self._operations: dict[str, Callable] = {}

    def add(self, name: str, handler: Callable) -> None:
        if name in self._operations:
            raise InputValidationError(f"{name} is registered already")
        self._operations[name] = handler

    def names(self) -> list[str]:
        return sorted(self._operations)

    def run(self, name: str, params: Mapping) -> dict:
        if name not in self._operations:
            raise OperationNotFoundError(f"no operation {name!r}")
        return self._operations[name](dict(params))
