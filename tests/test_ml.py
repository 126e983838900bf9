import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.ml import estimators, experiment, metrics, splits, trees


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(0), []
    for k in range(120):
        y = k % 2
        rows.append((*(float(v) for v in rng.normal(y * 2.5, 1, 4)), "f" if k % 3 else None, None if k == 5 else float(y), "pos" if y else "neg"))
    return spark.createDataFrame(rows, "a_w1 double, a_w2 double, b_w1 double, b_w2 double, sex string, extra double, target string").drop("extra").cache()


def test_split_texts():
    assert [splits.parse_split(x) for x in (None, "auto", "none", "k-fold", "", "70/30", "30", "25%", 0.2)] == [None] * 5 + [0.3, 0.3, 0.25, 0.2]
    for bad in ("x", "0", "1/0"):
        with pytest.raises(InputValidationError):
            splits.parse_split(bad)


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(k, "a" if k % 4 else "b") for k in range(103)], "k long, y string")
    for y in ("a", "b"):
        sizes = [r["count"] for r in splits.with_folds(df, "y", 5, 1, "k").filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    with pytest.raises(InputValidationError):
        splits.with_folds(df, "y", 40, 1, "k")
    held = splits.with_shuffles(df, "y", 0.2, 3, 1, "k")
    for k in range(3):
        n = {r["y"]: r["count"] for r in held.filter(F.array_contains("test_in", k)).groupBy("y").count().collect()}
        assert n == {"a": 15, "b": 5}


def test_metrics_by_hand(spark):
    rows = [(0, 0, [0.9, 0.1]), (0, 1, [0.4, 0.6]), (1, 1, [0.2, 0.8]), (1, 1, [0.4, 0.6]), (1, 0, [0.7, 0.3])]
    df = spark.createDataFrame([(float(y), float(p), q) for y, p, q in rows], "label double, prediction double, probability array<double>")
    m = metrics.evaluate(df, 2, list(metrics.METRICS))
    assert m["accuracy"] == m["f1_micro"] == pytest.approx(0.6)
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2) and m["geometric_mean"] == pytest.approx((0.5 * 2 / 3) ** 0.5)
    assert m["f1_macro"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert m["auroc"] == pytest.approx((3 + 1.5) / 6)  # pairs won, a tie counts half
    assert m["auprc"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)
    assert metrics.resolve("auc_roc, gmean") == ["auroc", "geometric_mean"]
    assert metrics.from_confusion(np.array([[3.0, 0], [2, 0]]), "geometric_mean") == 0.0
    with pytest.raises(InputValidationError):
        metrics.resolve("odd")
    with pytest.raises(InputValidationError):
        metrics.evaluate(df, 2, ["auroc"], has_probability=False)


@pytest.mark.parametrize("key", ["decision_tree", "extra_trees", "knn", "logistic_regression", "random_forest"])
def test_standard_estimators(data, key, tmp_path):
    e = experiment.run_standard(data, "target", key, metric_keys="f1_macro,auroc", cv_folds=2, output_dir=str(tmp_path))["multiclass"]
    assert e.summary["auroc"][0] > 0.8 and len(e.fold_scores["f1_macro"]) == 2 and sum(r["support"] for r in e.report) == 120
    assert json.loads((tmp_path / "summary.json").read_text())["estimator"] == key and "model" in e.files or key == "knn"


def test_three_classes_and_one_vs_rest(spark, data):
    three = data.withColumn("target", F.when(F.col("a_w1") > 2.5, "top").otherwise(F.col("target")))
    e = experiment.run_standard(three, "target", "decision_tree", cv_folds=2)["multiclass"]
    assert e.classes == ["neg", "pos", "top"]
    assert sorted(experiment.run_standard(three, "target", "decision_tree", cv_folds=2, multiclass_mode="one_vs_rest", validation_split="70/30")) == ["traj_neg_vs_rest", "traj_pos_vs_rest", "traj_top_vs_rest"]


def test_feature_groups(data):
    g = experiment.parse_groups(data.columns, "suffix", suffix="_w", target="target")
    assert g.groups == [["a_w1", "a_w2"], ["b_w1", "b_w2"]] and g.static == ["sex"]
    assert experiment.parse_groups(data.columns, "preset", preset="elsa", target="target") == g
    assert experiment.parse_groups(data.columns, "manual", "a_w1,a_w2,-1;2,3", target="target", static="sex").groups == [["a_w1", "a_w2", None], ["b_w1", "b_w2", None]]
    for bad in ("a_w1", "a_w1,zz", "a_w1,a_w2;a_w1,b_w1"):
        with pytest.raises(InputValidationError):
            experiment.parse_groups(data.columns, "manual", bad)


@pytest.mark.parametrize("key", ["merwav_time_minus__decision_tree", "aggrfunc_median__decision_tree", "sepwav_voting__decision_tree", "sepwav_stacking_dt__decision_tree", *(f"merwav_time_plus__{p}" for p in estimators.PLUS)])
def test_longitudinal_estimators(data, key):
    g = experiment.parse_groups(data.columns, "suffix", suffix="_w", target="target")
    e = experiment.run_longitudinal(data, "target", key, g, cv_folds=2)["multiclass"]
    assert e.summary["f1_macro"][0] > 0.7


def test_estimator_lists():
    assert len(estimators.LONGITUDINAL) == 47 and len(estimators.STANDARD) == 7
    assert "maxDepth" in estimators.parameters_of("random_forest") and estimators.parameters_of("knn") == ["n_neighbors"]


def test_lexicographic_choice_prefers_recent_waves():
    y = np.array([0, 1] * 40)
    x = np.stack([y, y], 1).astype(float)
    for recency, want in (([0, 1], 1), ([1, 0], 0)):
        assert trees.LexicoTree(2, recency).fit(x, y).nodes[0][0] == want


def test_benchmark_keeps_failures_last(data, tmp_path):
    b = experiment.run_benchmark(data, "target", estimators=["decision_tree", "svm"], metric_keys="auroc", cv_folds=2, output_root=str(tmp_path))
    assert [r["estimator_key"] for r in b.ranking] == ["decision_tree", "svm"] and b.ranking[1]["mean_score"] == -1.0 and set(b.skipped) == {"svm"}
    assert (tmp_path / "ranking.html").exists() and json.loads((tmp_path / "benchmark.ipynb").read_text())["nbformat"] == 4


def test_shapley_values_find_the_feature(spark):
    df = spark.createDataFrame([(float(k % 7), float(k % 3)) for k in range(60)], "x double, z double")
    score = lambda d: d.withColumn("prediction", 3 * F.col("x"))
    got = {r["feature"]: r["mean_abs_shap"] for r in experiment.shapley_importance(df, ["x", "z"], score, rows=20, background=20, permutations=3).collect()}
    assert got["z"] == 0 and got["x"] > 1


def test_bad_targets(data):
    for kw in ({"target": "nope"}, {"target": "target", "features": "target"}):
        with pytest.raises(InputValidationError):
            experiment.run_standard(data, kw["target"], "knn", features=kw.get("features", "auto"))
    with pytest.raises(InputValidationError):
        experiment.run_standard(data.filter("target = 'pos'"), "target", "knn")
    with pytest.raises(InputValidationError, match="not available"):
        experiment.model_preset()
