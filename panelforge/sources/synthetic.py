"""Synthetic long panels (G1-G7): expressions over ``spark.range``, so any number of subjects is made in parallel.

Random numbers are hashes of (seed, purpose, subject, wave), so a subject's values depend on nothing else: not on
partitions, retries or the number of other subjects.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError

GENERATORS = ("trend_patterns", "event_shock_recovery", "piecewise_changepoint", "missing-data-scenarios", "harmonisation-challenge")
# Default classes as (name, intercept mean, slope mean, proportion).
DEFAULT_CLASSES = (("stable_high", 11.0, 0.0, 0.75), ("declining", 9.0, -1.5, 0.09), ("rising", 5.0, 1.2, 0.11), ("stable_low", 3.0, 0.0, 0.05))
MECHANISMS = ("mcar", "mar", "dropout", "mixed")
# Canonical labels with their shares and the spellings that corrupt them.
LABELS = {
    "site_label": {"North": (0.3, ("north", "NORTH", "Nrth", "North ")), "South": (0.3, ("south", "SOUTH", "Sth")), "East": (0.2, ("east", "EAST", "Est")), "West": (0.2, ("west", "WEST", "Wst"))},
    "sex_label": {"Female": (0.52, ("female", "F", "FEMALE")), "Male": (0.48, ("male", "M", "MALE"))},
    "treatment_group": {"Control": (0.5, ("control", "CTRL", "Ctl")), "Intervention": (0.5, ("intervention", "INT", "Intervntion"))},
    "ethnicity_group": {"White": (0.6, ("white", "WHITE")), "Asian": (0.2, ("asian", "ASIAN")), "Black": (0.12, ("black", "BLACK")), "Mixed": (0.08, ("mixed", "MIXED"))},
}


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A uniform number in (0, 1) that depends on the arguments only."""
    h = F.xxhash64(F.lit(seed), F.lit(purpose), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, purpose: str, *keys: Column) -> Column:
    """A standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, purpose + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, purpose + "/a", *keys))


def _choose(u: Column, options: Sequence[tuple[object, float]]) -> Column:
    total, acc, out = sum(p for _, p in options), 0.0, None
    for value, p in options:
        acc += p / total
        out = F.when(u < acc, F.lit(value)) if out is None else out.when(u < acc, F.lit(value))
    return out.otherwise(F.lit(options[-1][0]))


def _panel(spark: SparkSession, n_samples: int, n_waves: int) -> DataFrame:
    if n_samples < 1 or n_waves < 1:
        raise InputValidationError("samples and waves must be positive")
    return spark.range(1, n_samples + 1).select(F.col("id").alias("subject_id"), F.explode(F.expr(f"sequence(1L, {int(n_waves)}L)")).alias("wave"))


def class_specs(mode: str = "default", custom_json: str | None = None, seed: int = 42) -> list[tuple[str, float, float, float]]:
    """Classes (name, intercept, slope, proportion): the default ones, random ones, or a JSON list of objects."""
    if mode == "default":
        return list(DEFAULT_CLASSES)
    if mode == "random":
        import random

        rng = random.Random(seed)
        levels = sorted((rng.uniform(2, 12) for _ in range(4)), reverse=True)
        up, down = rng.uniform(0.5, 2), rng.uniform(0.5, 2)
        return [(n, level, slope, p) for (n, _, _, p), level, slope in zip(DEFAULT_CLASSES, levels, (0.0, -down, up, 0.0))]
    if mode != "custom" or not custom_json:
        raise InputValidationError("spec_mode must be default, random, or custom with a JSON list")
    try:
        specs = [(str(x["name"]), float(x["intercept"]), float(x["slope"]), float(x["proportion"])) for x in json.loads(custom_json)]
    except (ValueError, KeyError, TypeError) as e:
        raise InputValidationError(f"class specs cannot be read: {e}") from e
    if not specs or min(p for *_, p in specs) <= 0:
        raise InputValidationError("proportions must be positive")
    return specs


def trend_patterns(spark: SparkSession, *, n_samples: int = 500, n_waves: int = 4, random_state: int = 42, feature_cols: Sequence[str] = ("depressive_score",), spec_mode: str = "default", custom_class_specs_json: str | None = None, intercept_sd: float = 1.0, slope_sd: float = 0.2, noise_sd: float = 1.0, keep_class: bool = False) -> DataFrame:
    """Classes of straight lines: intercept and slope are drawn per subject and feature, noise per wave; times are 0, 1, ..."""
    specs, s = class_specs(spec_mode, custom_class_specs_json, random_state), F.col("subject_id")
    df = _panel(spark, n_samples, n_waves).withColumn("__class", _choose(uniform(random_state, "class", s), [(i, p) for i, (*_, p) in enumerate(specs)]))
    at = lambda k: F.get(F.array(*(F.lit(float(x[k])) for x in specs)), F.col("__class"))
    made = []
    for f in feature_cols:
        a = at(1) + intercept_sd * normal(random_state, f"a/{f}", s)
        b = at(2) + slope_sd * normal(random_state, f"b/{f}", s)
        made.append((a + b * (F.col("wave") - 1) + noise_sd * normal(random_state, f"e/{f}", s, F.col("wave"))).alias(f))
    return df.select("subject_id", "wave", *made, *([F.col("__class").alias("true_class")] if keep_class else []))


def event_shock_recovery(spark: SparkSession, *, n_samples: int = 500, n_waves: int = 6, random_state: int = 42, feature_cols: Sequence[str] = ("depressive_score",), shock_wave: int = 3, shock_mean: float = 4.0, recovery_rate: float = 0.8, noise_sd: float = 1.0) -> DataFrame:
    """A line with a shock from ``shock_wave`` on that decays at ``recovery_rate``; further features are noisy copies."""
    if not 1 < shock_wave < n_waves:
        raise InputValidationError("shock_wave must lie between the first and the last wave")
    s, w = F.col("subject_id"), F.col("wave")
    n = lambda p, *k: normal(random_state, p, s, *k)
    shock = F.when(w >= shock_wave, (shock_mean + 0.8 * n("shock")) * F.exp(-recovery_rate * (w - shock_wave))).otherwise(0.0)
    base = 6 + 1.2 * n("a") + 0.3 * n("b") * (w - 1) + shock + noise_sd * n("e", w)
    df = _panel(spark, n_samples, n_waves).withColumn("__base", base)
    return df.select("subject_id", "wave", *((F.col("__base") + (0.3 * n(f"f/{f}", w) if i else 0.0)).alias(f) for i, f in enumerate(feature_cols)))


def piecewise_changepoint(spark: SparkSession, *, n_samples: int = 500, n_waves: int = 6, random_state: int = 42, feature_cols: Sequence[str] = ("depressive_score",), changepoint_wave: int = 3, noise_sd: float = 1.0, pre_slope_sd: float = 0.5, post_slope_sd: float = 0.5) -> DataFrame:
    """Two lines that meet at ``changepoint_wave``."""
    if not 1 < changepoint_wave < n_waves:
        raise InputValidationError("changepoint_wave must lie between the first and the last wave")
    s, w = F.col("subject_id"), F.col("wave")
    n = lambda p, *k: normal(random_state, p, s, *k)
    pre = pre_slope_sd * n("pre")
    post = pre + post_slope_sd * n("post")
    line = 7 + 1.5 * n("a") + pre * (F.least(w, F.lit(changepoint_wave)) - 1) + post * F.greatest(w - changepoint_wave, F.lit(0))
    df = _panel(spark, n_samples, n_waves).withColumn("__base", line + noise_sd * n("e", w))
    return df.select("subject_id", "wave", *((F.col("__base") + (0.25 * n(f"f/{f}", w) if i else 0.0)).alias(f) for i, f in enumerate(feature_cols)))


def missing_data_scenarios(spark: SparkSession, *, n_samples: int = 500, n_waves: int = 6, random_state: int = 42, feature_cols: Sequence[str] = ("depressive_score", "anxiety_score", "sleep_score"), mechanism: str = "mixed", missing_rate: float = 0.2, dropout_rate: float = 0.25, mar_strength: float = 1.25) -> DataFrame:
    """A panel with cells missing at random (``mcar``), by a subject's observed level and wave (``mar``), from a wave on
    (``dropout``), or by all three."""
    if mechanism not in MECHANISMS or not 0 <= missing_rate <= 1 or not 0 <= dropout_rate <= 1:
        raise InputValidationError("unknown mechanism or a rate outside 0..1")
    s, w, seed = F.col("subject_id"), F.col("wave"), random_state
    df = _panel(spark, n_samples, n_waves)
    step = w - 1
    signal = 8 + 1.8 * normal(seed, "base", s) + 0.35 * normal(seed, "slope", s) * step + 0.22 * step
    site = _choose(uniform(seed, "site", s), [(x, 0.25) for x in ("North", "South", "East", "West")])
    df = df.select(
        "subject_id", "wave", F.floor(9 + 6 * uniform(seed, "age", s)).alias("age_baseline"), F.when(uniform(seed, "sex", s) < 0.52, "Female").otherwise("Male").alias("sex"), site.alias("site"),
        *((signal + 0.55 * i + 0.9 * normal(seed, f"e/{f}", s, w)).alias(f) for i, f in enumerate(feature_cols)),
    )
    anchor = "depressive_score" if "depressive_score" in feature_cols else feature_cols[0]
    # the anchor's distribution is one row; it becomes two literals
    mean, sd = df.agg(F.avg(anchor), F.stddev_pop(anchor)).first()
    z = (F.col(anchor) - F.lit(mean)) / F.lit(sd or 1.0)
    scaled = step / F.lit(max(1, n_waves - 1))
    logit = 1 / (1 + F.exp(-(-0.9 + mar_strength * z + 0.8 * scaled)))
    p_mar = F.least(F.greatest(missing_rate * (0.35 + logit), F.lit(0.0)), F.lit(0.98))
    leaves = F.when(uniform(seed, "drop", s) < dropout_rate, F.floor(2 + uniform(seed, "from", s) * (n_waves - 1)))
    gone = F.coalesce(w >= leaves, F.lit(False)) if mechanism in ("dropout", "mixed") else F.lit(False)
    cells = []
    for f in feature_cols:
        lost = gone
        if mechanism in ("mcar", "mixed"):
            lost = lost | (uniform(seed, f"mcar/{f}", s, w) < missing_rate * (0.5 if mechanism == "mixed" else 1.0))
        if mechanism in ("mar", "mixed"):
            lost = lost | (uniform(seed, f"mar/{f}", s, w) < p_mar * (0.5 if mechanism == "mixed" else 1.0))
        cells.append(F.when(~lost, F.col(f)).alias(f))
    out = df.select("subject_id", "wave", "age_baseline", "sex", "site", *cells, F.lit(mechanism).alias("missingness_mechanism"))
    count = sum((F.col(f).isNull().cast("long") for f in feature_cols[1:]), F.col(feature_cols[0]).isNull().cast("long"))
    return out.withColumn("missing_feature_count", count)


def harmonisation_challenge(spark: SparkSession, *, n_samples: int = 450, n_waves: int = 5, random_state: int = 42, feature_cols: Sequence[str] = ("depressive_score", "anxiety_score"), noise_rate: float = 0.35, missing_label_rate: float = 0.03, include_canonical_columns: bool = True, labels: Mapping | None = None) -> DataFrame:
    """A panel whose labels are spelled in variants or missing, with the true labels beside them on request."""
    if not 0 <= noise_rate <= 1 or not 0 <= missing_label_rate <= 1:
        raise InputValidationError("rates must lie between 0 and 1")
    labels = labels or LABELS
    s, w, seed = F.col("subject_id"), F.col("wave"), random_state
    df = _panel(spark, n_samples, n_waves)
    df = df.select("*", *(_choose(uniform(seed, c, s), [(k, p) for k, (p, _) in own.items()]).alias(f"{c}_canonical") for c, own in labels.items()))
    made = []
    for c, own in labels.items():
        true = F.col(f"{c}_canonical")
        variants = F.create_map(*(x for k, (_, v) in own.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[true]
        noisy = F.element_at(variants, (F.floor(uniform(seed, f"{c}/which", s, w) * F.size(variants)) + 1).cast("int"))
        spelled = F.when(uniform(seed, f"{c}/noise", s, w) < noise_rate, noisy).otherwise(true)
        made.append(F.when(uniform(seed, f"{c}/null", s, w) >= missing_label_rate, spelled).alias(c))
    treated = (F.col("treatment_group_canonical") == "Intervention").cast("double") if "treatment_group" in labels else F.lit(0.0)
    step = w - 1
    signal = 7.2 + 1.7 * normal(seed, "base", s) + 0.3 * normal(seed, "trend", s) * step - 0.45 * treated * step
    values = [(signal + 0.65 * i + 0.95 * normal(seed, f"e/{f}", s, w)).alias(f) for i, f in enumerate(feature_cols)]
    canonical = [F.col(f"{c}_canonical") for c in labels] if include_canonical_columns else []
    return df.select("subject_id", "wave", *made, *values, *canonical, F.lit(float(noise_rate)).alias("label_noise_rate"), F.lit(float(missing_label_rate)).alias("missing_label_rate"))


def generate(spark: SparkSession, generator: str, **params) -> DataFrame:
    """A panel by the generator's name; ``-`` and ``_`` are alike."""
    made = {"trend_patterns": trend_patterns, "event_shock_recovery": event_shock_recovery, "piecewise_changepoint": piecewise_changepoint, "missing_data_scenarios": missing_data_scenarios, "harmonisation_challenge": harmonisation_challenge}
    f = made.get(generator.replace("-", "_"))
    if f is None:
        raise InputValidationError(f"generator must be one of {', '.join(GENERATORS)}")
    return f(spark, **params)
