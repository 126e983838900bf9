"""Metrics (M5-M6): all from counts, so predictions are aggregated and never collected."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.operators.ranks import prefix_counts

ALIASES = {"auc_roc": "auroc", "roc_auc": "auroc", "gmean": "geometric_mean", "geo_mean": "geometric_mean", "average_precision": "auprc", "f1": "f1_macro", "precision": "precision_macro", "recall": "recall_macro"}
CONFUSION = ("accuracy", "balanced_accuracy", "f1_macro", "f1_micro", "f1_weighted", "precision_macro", "precision_micro", "precision_weighted", "recall_macro", "recall_micro", "recall_weighted", "geometric_mean", "matthews_corrcoef", "cohen_kappa")
RANKED = ("auroc", "auprc", "neg_log_loss", "neg_brier_score")
METRICS = (*CONFUSION, *RANKED)


def resolve(names: str | Sequence[str]) -> list[str]:
    """Metric names from a list or comma text, aliases resolved."""
    given = [x.strip() for x in names.split(",")] if isinstance(names, str) else list(names)
    out = [ALIASES.get(x.lower(), x.lower()) for x in given if x]
    unknown = [x for x in out if x not in METRICS]
    if unknown or not out:
        raise InputValidationError(f"unknown metric {', '.join(unknown) or '(none)'}; there are {', '.join(METRICS)}")
    return list(dict.fromkeys(out))


def confusion(predictions: DataFrame, n_classes: int, label: str = "label", prediction: str = "prediction") -> np.ndarray:
    """Rows: true class, columns: predicted class."""
    out = np.zeros((n_classes, n_classes))
    for r in predictions.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).count().collect():
        out[r["y"], r["p"]] += r["count"]
    return out


def from_confusion(c: np.ndarray, name: str) -> float:
    n, right, true, told = c.sum(), np.diag(c), c.sum(1), c.sum(0)
    there = (true > 0) | (told > 0)
    recall = np.divide(right, true, out=np.zeros_like(right), where=true > 0)
    precision = np.divide(right, told, out=np.zeros_like(right), where=told > 0)
    f1 = np.divide(2 * precision * recall, precision + recall, out=np.zeros_like(right), where=precision + recall > 0)
    if name == "accuracy" or name.endswith("_micro"):
        return float(right.sum() / n) if n else float("nan")
    if name == "balanced_accuracy":
        return float(recall[true > 0].mean()) if (true > 0).any() else float("nan")
    if name == "geometric_mean":
        own = recall[true > 0]
        return float(np.exp(np.log(own).mean())) if len(own) and (own > 0).all() else 0.0
    if name == "matthews_corrcoef":
        a, b = n * n - (told**2).sum(), n * n - (true**2).sum()
        return float((right.sum() * n - (told * true).sum()) / np.sqrt(a * b)) if a * b > 0 else 0.0
    if name == "cohen_kappa":
        e = (told * true).sum() / (n * n) if n else 0.0
        return float((right.sum() / n - e) / (1 - e)) if n and e < 1 else 0.0
    values = {"f1": f1, "precision": precision, "recall": recall}[name.rsplit("_", 1)[0]]
    if name.endswith("_macro"):
        return float(values[there].mean()) if there.any() else float("nan")
    return float((values * true).sum() / n) if n else float("nan")


def ranked_scores(scores: DataFrame) -> tuple[float, float]:
    """(area under the ROC curve, average precision) of rows (y 0/1, score), ties sharing one threshold.

    Rows are reduced to counts per distinct score; prefix counts over range-sorted scores give the thresholds.
    """
    per = scores.groupBy((-F.col("score")).alias("s")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("all", F.lit(0))
    c = prefix_counts(per, ["all"], "s", ["pos", "neg"]).select("pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    r = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")).first()
    if not r["p"] or not r["n"]:
        return float("nan"), float("nan")
    return float(r["area"] / (r["p"] * r["n"])), float(r["ap"] / r["p"])


def evaluate(predictions: DataFrame, n_classes: int, names: Sequence[str], *, has_probability: bool = True) -> dict[str, float]:
    """Metrics of (label, prediction, probability array). Multiclass rankings are one-vs-rest macro means."""
    need = [x for x in names if x in RANKED]
    if need and not has_probability:
        raise InputValidationError(f"{', '.join(need)} needs class probabilities, which this estimator does not give")
    c = confusion(predictions, n_classes)
    out = {x: from_confusion(c, x) for x in names if x in CONFUSION}
    if "auroc" in need or "auprc" in need:
        pairs = [ranked_scores(predictions.select((F.col("label") == k).cast("int").alias("y"), F.col("probability")[k].alias("score"))) for k in ([1] if n_classes == 2 else range(n_classes)) if c.sum(1)[k] > 0]
        for name, at in (("auroc", 0), ("auprc", 1)):
            if name in need:
                out[name] = float(np.nanmean([p[at] for p in pairs])) if pairs else float("nan")
    if "neg_log_loss" in need:
        p = F.greatest(F.get("probability", F.col("label").cast("int")), F.lit(1e-15))
        out["neg_log_loss"] = float(predictions.agg(F.avg(F.log(p))).first()[0])
    if "neg_brier_score" in need:
        gaps = F.aggregate(F.transform("probability", lambda x, i: F.pow(x - (i == F.col("label").cast("int")).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
        out["neg_brier_score"] = -float(predictions.agg(F.avg(gaps / (2 if n_classes == 2 else 1))).first()[0])
    return {x: out[x] for x in names}


def report(c: np.ndarray, labels: Sequence[str]) -> list[dict]:
    """Precision, recall, f1 and support per class."""
    out = []
    for k, name in enumerate(labels):
        tp, told, true = c[k, k], c[:, k].sum(), c[k].sum()
        p, r = (tp / told if told else 0.0), (tp / true if true else 0.0)
        out.append({"label": str(name), "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "support": int(true)})
    return out
