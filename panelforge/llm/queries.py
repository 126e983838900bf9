"""Queries of problems 4 to 8 over the tables of the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.functions.exprs import family_key, not_nan
from panelforge.llm import clusters, leaks, mixing, spam, splits
from panelforge.plans.tables import table

SCORES = ("depressive_score", "anxiety_score", "sleep_score")
WAVES = 7
# The missing codes of the scores and the number that stands for an unknown person.
MISSING_CODES = (-9.0, -8.0, -1.0, 999.0)
UNKNOWN_PERSON = 999999999


def _groups(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "subjects").select("subject_id", family_key(F.col("mcsid")).alias("family"))
    people = table(spark, d, "parents").filter((F.col("person_id") > 0) & (F.col("person_id") != UNKNOWN_PERSON))
    people = people.select(family_key(F.col("mcsid")).alias("family"), "person_id").filter("family IS NOT NULL")
    return splits.related_groups(subjects, "subject_id", subjects, "family", people, "person_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    grouped = _groups(spark, d).filter("subject_id <> group_id")
    return grouped.select(F.col("group_id").alias("group_subject_id"), "subject_id").distinct()


def _sex(c: Column) -> Column:
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(first.isin("F", "M"), first).otherwise("unknown")


def _split(spark: SparkSession, d: str, shares: dict[str, float]) -> DataFrame:
    groups = _groups(spark, d).select(F.col("subject_id").alias("of"), "group_id")
    rows = table(spark, d, "subjects").select("row_id", "subject_id", _sex(F.col("sex_label")).alias("label"))
    rows = rows.join(groups, F.col("subject_id") == F.col("of"), "left").drop("of")
    # a row without subject_id is a group of its own
    rows = rows.withColumn("group_id", F.coalesce("group_id", -F.col("row_id")))
    return splits.assign_splits(rows, "group_id", "label", shares).select("row_id", "subject_id", "group_id", "label", "split")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets").filter("split_name IS NOT NULL AND target_share > 0").groupBy("split_name").agg(F.min("target_share").alias("target_share")).limit(1001).collect()
    if len(targets) > 1000:
        raise InputValidationError("at most 1000 splits")
    return _split(spark, d, {r["split_name"]: r["target_share"] for r in targets})


def p4_folds(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, {f"fold_{k}": 1.0 for k in range(5)})


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each label per split, as shares of the label's rows."""
    rows = p4_splits(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))
    from pyspark.sql import Window

    return rows.withColumn("share_of_label", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("label")))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows without a split, groups in several splits (both 0), and whether each label's shares are within 0.01 of the targets."""
    rows = cut(p4_splits(spark, d))
    parted = rows.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_parted"))
    label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    targets = table(spark, d, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    shares = rows.groupBy("label", "split").agg(F.count(F.lit(1)).alias("own")).join(label, "label").join(targets, "split")
    near = shares.agg(F.coalesce(F.max(F.abs(F.col("own") / F.col("n") - F.col("target_share"))) <= 0.01, F.lit(True)).alias("near_targets"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split").isNull()).alias("n_unassigned")).join(F.broadcast(parted)).join(F.broadcast(near))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether no document has more copies than allowed and whether the tokens drawn are within 1 % of the target, or of all that the cap allows."""
    total = F.col("tokens_drawn") / F.col("share_of_corpus")
    goal = F.least(F.col("target_share") * total, F.col("max_repeats") * F.col("tokens_available"))
    near = F.when(F.col("tokens_drawn") > 0, F.abs(F.col("tokens_drawn") - goal) <= 0.01 * goal).otherwise(F.col("tokens_available") == 0)
    return p7_shares(spark, d).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_target"))


def _curves(spark: SparkSession, d: str) -> DataFrame:
    panel = table(spark, d, "panel_long").filter(F.col("subject_id").isNotNull() & F.col("wave").between(1, WAVES))
    valid = panel.select("subject_id", "wave", *(F.when(~not_nan(F.col(c)).isin(*MISSING_CODES), not_nan(F.col(c))).alias(c) for c in SCORES))
    means = [F.avg(F.when(F.col("wave") == w, F.col(c))) for c in SCORES for w in range(1, WAVES + 1)]
    return valid.groupBy("subject_id").agg(F.array(*means).alias("curve"))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    curves = _curves(spark, d)
    return clusters.density_clusters(curves, "subject_id", "curve", dims=len(SCORES) * WAVES), curves


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _clusters(spark, d)
    return found.filter("subject_id <> cluster_id").select(F.col("cluster_id").alias("cluster_subject_id"), "subject_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    found, curves = _clusters(spark, d)
    return clusters.describe_clusters(found, curves, "subject_id", "curve", dims=len(SCORES) * WAVES)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (p4_found, p4_splits, p4_folds, p4_report, p4_checks, p5_found, p5_groups, p6_found, p7_mix, p7_shares, p7_checks, p8_found, p8_scores)}
