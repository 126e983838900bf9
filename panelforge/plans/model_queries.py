"""Queries of operators that SQL cannot express: generators, trajectories, chained imputation, learning, pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.exprs import family_key, not_nan
from panelforge.ml import estimators, experiment
from panelforge.ml.splits import with_folds
from panelforge.operators import aggregate, impute, reshape
from panelforge.plans import prepare as prep
from panelforge.plans import preprocess as prepro
from panelforge.plans.reference_queries import SCORES, clean_panel
from panelforge.plans.tables import table
from panelforge.sources import synthetic
from panelforge.trajectories.base import build_trajectories


def _complete_panel(spark: SparkSession, d: str) -> DataFrame:
    """Mean curves of the subjects that have all three scores in all waves of the panel."""
    curves = aggregate.mean_curves(clean_panel(spark, d).filter("subject_id IS NOT NULL AND wave BETWEEN 1 AND 7"), "subject_id", "wave", SCORES).dropna()
    whole = curves.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 7").select("subject_id")
    return curves.join(whole, "subject_id", "left_semi")


def trajectories_dtw(spark, d):
    return build_trajectories(_complete_panel(spark, d), "dtw_kmeans", value_cols=list(SCORES), n_trajectories=4).assignments


def trajectories_lcga(spark, d):
    return build_trajectories(_complete_panel(spark, d), "lcga", value_cols=["depressive_score"], n_trajectories=3).assignments


def trajectories_gmm(spark, d):
    return build_trajectories(_complete_panel(spark, d), "gmm", value_cols=["depressive_score"], n_trajectories=3).assignments


def trajectories_spline(spark, d):
    return build_trajectories(clean_panel(spark, d), "clustermld", value_cols=["depressive_score"], n_trajectories=4).assignments


def impute_mice(spark, d):
    wide = table(spark, d, "wide_features").select("row_id", *(not_nan(F.col(c)).alias(c) for c in ("emotion_w2", "emotion_w3", "emotion_w4", "apgehe00_w1")))
    return impute.impute(wide, "mice_imputation", columns=["emotion_w2", "emotion_w3", "emotion_w4", "apgehe00_w1"])


def impute_mice_checks(spark, d):
    """Per column: rows, cells imputed, observed cells changed, cells left empty, and values that no row had (all 0 but the first two)."""
    columns = ("emotion_w2", "emotion_w3", "emotion_w4", "apgehe00_w1")
    before = table(spark, d, "wide_features").select("row_id", *(not_nan(F.col(c)).alias(c) for c in columns))
    after = impute_mice(spark, d).select("row_id", *(F.col(c).alias(f"{c}_new") for c in columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("old"), F.col(f"{c}_new").alias("new")) for c in columns)))
    cell = before.join(after, "row_id").select(cells.alias("x")).select("x.*")
    counted = cell.groupBy("column_name", "old", "new").agg(F.count(F.lit(1)).alias("n"))
    seen = counted.filter("old IS NOT NULL").select("column_name", F.col("old").alias("new"), F.lit(True).alias("seen")).distinct()
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    old, new = F.col("old"), F.col("new")
    return counted.join(seen, ["column_name", "new"], "left").groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), n(old.isNull()).alias("n_imputed"), n(old.isNotNull() & ~new.eqNullSafe(old)).alias("n_changed"), n(new.isNull()).alias("n_left"), n(new.isNotNull() & F.col("seen").isNull()).alias("n_foreign")
    )


def trajectory_checks(spark, d):
    """Per builder: subjects with a class, rows beyond one a subject, and classes outside the wanted number (both 0)."""
    runs = {"dtw_kmeans": (trajectories_dtw, 4), "lcga": (trajectories_lcga, 3), "gmm": (trajectories_gmm, 3)}
    parts = [run(spark, d).agg(F.lit(name).alias("builder"), F.count_distinct("subject_id").alias("n_subjects"), (F.count(F.lit(1)) - F.count_distinct("subject_id")).alias("n_repeated"), F.count_if(~F.col("trajectory_id").between(0, k - 1)).alias("n_outside")) for name, (run, k) in runs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stratified_fold_sizes(spark, d):
    return stratified_folds(spark, d).groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


def stratified_folds(spark, d):
    return with_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 5, 42, "o_orderkey")


def _features(spark: SparkSession, d: str) -> DataFrame:
    wide = reshape.pivot_long_to_wide(_complete_panel(spark, d), ["subject_id"], "wave", time_label="w", times=range(1, 8), validate=False)
    level = F.when(F.col("sleep_score_w7") > F.col("sleep_score_w1"), "up").otherwise("down")
    return wide.withColumn("target", level).drop("subject_id", "sleep_score_w7", "sleep_score_w1")


def ml_standard_cv(spark, d):
    done = experiment.run_standard(_features(spark, d), "target", "logistic_regression", metric_keys="f1_macro,auroc")["multiclass"]
    return spark.createDataFrame([(m, i, float(v)) for m, x in done.fold_scores.items() for i, v in enumerate(x)], "metric string, fold int, score double")


def ml_longitudinal_cv(spark, d):
    df = _features(spark, d)
    groups = experiment.parse_groups(df.columns, "suffix", suffix="_w", target="target")
    done = experiment.run_longitudinal(df, "target", "merwav_time_plus__lexico_decision_tree", groups, metric_keys="f1_macro")["multiclass"]
    return spark.createDataFrame([(m, i, float(v)) for m, x in done.fold_scores.items() for i, v in enumerate(x)], "metric string, fold int, score double")


def shapley_importance(spark, d):
    df = _features(spark, d)
    rows, names, classes = experiment.prepare(df, "target")
    model = estimators.fit_standard(rows, names, "label", len(classes), "decision_tree", 42)
    return experiment.shapley_importance(df, names, model.score, rows=200, background=100)


def prepare_panel(spark, d):
    """Child, parent and link tables of all waves through the preparation pipeline, as one long panel."""
    subjects = table(spark, d, "subjects").withColumn("MCSID", family_key(F.col("mcsid"))).filter("MCSID IS NOT NULL AND cnum > 0")
    child = subjects.groupBy("MCSID", "cnum").agg(F.min("age_baseline").alias("AGE"))
    people = table(spark, d, "parents").withColumn("MCSID", family_key(F.col("mcsid"))).groupBy("MCSID", "pnum").agg(F.max(not_nan(F.col("apgehe00"))).alias("APGEHE00"))
    link = table(spark, d, "child_parent_link").withColumn("MCSID", family_key(F.col("mcsid")))
    waves = []
    for w in range(1, 8):
        own = link.filter(F.col("wave") == f"W{w}").groupBy("MCSID", "cnum", "pnum").agg(F.max(not_nan(F.col("acadmo00"))).alias("ACADMO00"))
        tables = [prep.SourceTable("child", "cm", child, "cnum"), prep.SourceTable("parent", "parent", people, None, "pnum"), prep.SourceTable("link", "link", own, "cnum", "pnum")]
        waves.append(prep.WaveInput(f"W{w}", tables, {"ACADMO00": ("p1__link__ACADMO00", None), "APGEHE00": ("p1__parent__APGEHE00", None)}, {"AGE": ("cm__AGE", None)} if w == 1 else {}))
    return prep.prepare(waves, output="long").long


def preprocess_panel(spark, d):
    """The wide panel of all loads through the preprocessing pipeline."""
    C, N, B, O = (lambda k, **x: prepro.RootPolicy(k, **x),) * 4
    wide = table(spark, d, "wide_features").drop("load_id", "extract_id", "load_no", "loaded_at", "chid", "interview_month_w2", "area_code_w1")
    policy = prepro.Policy(
        target="emotion_w7", keep_ids=["row_id"], drop_ids=["mcsid", "cnum"], target_history=["emotion_w2"], leakage=["emotion_w3"], baseline_roots=["ahcsex00"],
        root_overrides={"adoede00": [-2, -1]},
        encodings={
            "adoede00": C("continuous"), "emotion": C("continuous"), "apdist9": C("continuous"), "adroow00": N("nominal", codes=[1, 2, 3]), "adc06e00": N("nominal", codes=[1, 2]), "apgehe00": O("ordinal"), "apaldr00": O("ordinal"), "apwali00": O("ordinal"),
            "apdean00": B("binary", mapping={1: 1, 2: 0}), "apsmma00": B("binary", mapping={1: 1, 2: 0}), "ahcsex00": B("binary", mapping={1: 0, 2: 1}), "adacaq00": O("ordinal", ordered=[1, 2, 3, 4, 5, 95]),
        },
    )
    return prepro.preprocess(wide, policy).data


def _synth(name: str):
    return lambda spark, d: synthetic.generate(spark, name, n_samples=500)


def queries():
    own = (trajectories_dtw, trajectories_lcga, trajectories_gmm, trajectories_spline, impute_mice, impute_mice_checks, trajectory_checks, stratified_folds, stratified_fold_sizes, ml_standard_cv, ml_longitudinal_cv, shapley_importance, prepare_panel, preprocess_panel)
    return {f.__name__: f for f in own} | {f"synth_{g.replace('-', '_')}": _synth(g) for g in synthetic.GENERATORS}
