"""Queries of the general problems 1 to 3 over the tables of the project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.exprs import family_key, id_number, strip
from panelforge.operators import drift, quality, references
from panelforge.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "raw_records"), table(spark, d, "feature_mapping"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify_records(table(spark, d, "raw_records"), table(spark, d, "feature_mapping"))


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of every file: values, nulls and the type of most values."""
    records = table(spark, d, "raw_records").filter(F.col("file_id").isNotNull())
    return drift.profile_fields(drift.read_fields(records))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).withColumn("missing_share", F.round("missing_share", 9)).withColumn("ks_distance", F.round("ks_distance", 9))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_profile(table(spark, d, "wide_features"), table(spark, d, "feature_codebook"), load="load_id", series="extract_id", step="load_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(_profile(spark, d))


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The valid subjects, and the valid children (family and number) with the times of their subject."""
    rows = table(spark, d, "subjects").select("subject_id", family_key(F.col("mcsid")).alias("family"), F.when(F.col("cnum") > 0, F.col("cnum")).alias("number"), "registered_at", "withdrawn_at")
    own = rows.filter("subject_id IS NOT NULL").groupBy("subject_id").agg(F.min("registered_at").alias("since"), F.min("withdrawn_at").alias("until"))
    keys = rows.filter("family IS NOT NULL AND number IS NOT NULL").select("subject_id", "family", "number").distinct()
    return own, keys.join(own, "subject_id", "left")


def checked_references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of the three tables with its cause: table_name, record_id, ref_name, at, cause."""
    own, children = _subjects(spark, d)
    parents = table(spark, d, "parents").select(family_key(F.col("mcsid")).alias("family"), F.when(F.col("pnum") > 0, F.col("pnum")).alias("number"))
    text = strip(F.col("subject_id"))
    panel = table(spark, d, "panel_long").select(F.col("obs_id").alias("record_id"), F.col("observed_at").alias("at"), F.col("subject_id").cast("long").alias("ref"))
    assign = table(spark, d, "trajectory_assignments").select(
        F.col("assign_id").alias("record_id"), F.col("assigned_at").alias("at"), F.when(~F.upper(text).isin("", "NA"), F.coalesce(id_number(text), F.lit(-1).cast("long"))).alias("ref")
    )
    link = table(spark, d, "child_parent_link").select(F.col("link_id").alias("record_id"), F.col("interviewed_at").alias("at"), family_key(F.col("mcsid")).alias("family"), F.when(F.col("cnum") > 0, F.col("cnum")).alias("child"), F.when(F.col("pnum") > 0, F.col("pnum")).alias("parent"))

    def named(df: DataFrame, name: str, ref: str) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), "record_id", F.lit(ref).alias("ref_name"), "at", "cause")

    times = {"at": "at", "since": "since", "until": "until"}
    parts = [
        named(references.check_references(panel, ["ref"], own, ["subject_id"], **times), "panel_long", "subject"),
        named(references.check_references(assign, ["ref"], own, ["subject_id"], **times), "trajectory_assignments", "subject"),
        named(references.check_references(link, ["family", "child"], children, ["family", "number"], **times), "child_parent_link", "child"),
        named(references.check_references(link, ["family", "parent"], parents, ["family", "number"]), "child_parent_link", "parent"),
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = checked_references(spark, d).filter(F.col("cause").isin("missing", "deleted", "late"))
    return found.filter("record_id IS NOT NULL").select("table_name", "record_id", "ref_name", "cause").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    checked = checked_references(spark, d).withColumn("period", F.coalesce(F.date_format("at", "yyyy"), F.lit("unknown")))
    return references.reference_report(checked, ["table_name", "ref_name", "period"])


def p3_partial(spark: SparkSession, d: str) -> DataFrame:
    """References of child_parent_link to parents with null parts, each mask matched on its non-null columns."""
    parents = table(spark, d, "parents").select(family_key(F.col("mcsid")).alias("family"), F.when(F.col("pnum") > 0, F.col("pnum")).alias("number"))
    link = table(spark, d, "child_parent_link").select("link_id", family_key(F.col("mcsid")).alias("family"), F.when(F.col("pnum") > 0, F.col("pnum")).alias("parent"))
    checked = references.check_references(link, ["family", "parent"], parents, ["family", "number"], match="partial")
    return checked.select("link_id", F.col("family").isNull().alias("no_family"), F.col("parent").isNull().alias("no_number"), "cause")


def queries():
    return {f.__name__: f for f in (p1_found, p1_fields, p1_unified, p2_found, p2_profile, p3_found, p3_partial, p3_report)}
