"""Schemas that drift between files (problem 1).

Every file's fields are profiled (presence, majority type); consecutive files of a series are compared.
Vanished and new fields become candidate pairs when a feature dictionary ties them to one canonical feature, or when
the records that both files share carry the same values there. Types and name similarity weigh the candidates, a
bipartite matching decides which pairs are renames, and the matched fields are unified under one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.session import cut
from panelforge.functions.exprs import NUMBER, integral_text, strip
from panelforge.operators.matching import best_matching

META = ["file_id", "cohort_id", "dataset", "wave", "file_seq"]


def field_type(kind: Column) -> Column:
    """Spark's name of a variant's type as one of integer, decimal, text, true/false, list, object; null for null."""
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)", 1).try_cast("int")
    return (
        F.when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL"), F.when(digits > 18, "integer").otherwise("decimal"))
        .when(kind.isin("DOUBLE", "FLOAT"), "decimal")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", "true/false")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
    )


def with_canonical_value(df: DataFrame) -> DataFrame:
    """Add ``canon``, the text of the variant ``value`` (of type ``kind``) however it is typed: numbers without trailing
    zeros, yes/no as 1/0, dates as digits, a list of one as its element, a coded object or ``code. label`` text as its
    code. Each step is a projection of its own, so that no expression is computed twice."""
    text, kind = F.col("__text"), F.col("kind")
    code = F.coalesce(F.try_variant_get("value", "$.code", "string"), F.try_variant_get("value", "$.value", "string"))
    df = df.withColumn("__text", F.when(kind.startswith("OBJECT"), F.coalesce(code, F.col("value").cast("string"))).otherwise(F.col("value").cast("string")))
    df = df.withColumn("__text", F.when(kind.startswith("ARRAY"), F.regexp_extract(text, r'^\["?(.*?)"?\]$', 1)).otherwise(text))
    df = df.withColumn("__text", F.lower(F.regexp_replace(F.regexp_replace(strip(text), r"^(\d+)\. [A-Za-z ]+$", "$1"), r"^(\d{4})-(\d{2})-(\d{2})$", "$1$2$3")))
    df = df.withColumn("__num", F.when(text.rlike(NUMBER), text.try_cast("double")))
    canon = F.when(text.isin("true", "yes", "y"), "1").when(text.isin("false", "no", "n"), "0").when(F.col("__num").isNotNull(), integral_text(F.col("__num"))).otherwise(text)
    return df.withColumn("canon", canon).drop("__text", "__num")


def read_fields(records: DataFrame) -> DataFrame:
    """One row per record and top-level payload key: meta columns, subject_key, field, type (null for a null), value."""
    parsed = records.select("record_id", *META, "subject_key", F.try_parse_json("payload").alias("__v"))
    spark = records.sparkSession
    exploded = parsed.filter(F.schema_of_variant("__v").startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
    typed = exploded.select("record_id", *META, "subject_key", F.col("key").alias("field"), "value", F.schema_of_variant("value").alias("kind"))
    return with_canonical_value(typed.withColumn("type", field_type(F.col("kind")))).drop("value", "kind")


def profile_fields(fields: DataFrame) -> DataFrame:
    """Per file and field: values, nulls, the type of most non-null values (ties: the first in the alphabet)."""
    typed = fields.groupBy("file_id", "field", "type").agg(F.count(F.lit(1)).alias("n"))
    return typed.groupBy("file_id", "field").agg(
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.min_by("type", F.when(F.col("type").isNotNull(), F.struct(-F.col("n"), F.col("type")))).alias("type"),
    )


def file_steps(records: DataFrame) -> DataFrame:
    """Each file with the preceding file of its series (cohort_id, dataset) in the order of file_seq, then file_id.

    A file is all rows of one file_id (its least meta values hold where they differ); rows without file_id are no file.
    """
    files = records.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(*(F.min(c).alias(c) for c in META[1:]))
    series = Window.partitionBy("cohort_id", "dataset").orderBy("file_seq", "file_id")
    return files.withColumn("prev_file_id", F.lag("file_id").over(series)).withColumn("prev_wave", F.lag("wave").over(series))


def field_steps(profile: DataFrame, steps: DataFrame) -> DataFrame:
    """Per file with a predecessor and field: whether it is in the old and in the new file, with its types."""
    pairs = steps.filter(F.col("prev_file_id").isNotNull()).select("file_id", "prev_file_id", "dataset", (F.col("wave") == F.col("prev_wave")).alias("same_wave"))
    p = profile.select(F.col("file_id").alias("of_file"), "field", "type")
    old = pairs.join(p, F.col("prev_file_id") == F.col("of_file")).select("file_id", "prev_file_id", "dataset", "same_wave", "field", F.lit(True).alias("in_old"), F.lit(None).cast("boolean").alias("in_new"), F.col("type").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    new = pairs.join(p, F.col("file_id") == F.col("of_file")).select("file_id", "prev_file_id", "dataset", "same_wave", "field", F.lit(None).cast("boolean").alias("in_old"), F.lit(True).alias("in_new"), F.lit(None).cast("string").alias("old_type"), F.col("type").alias("new_type"))
    return old.unionByName(new).groupBy("file_id", "prev_file_id", "dataset", "same_wave", "field").agg(
        F.coalesce(F.max("in_old"), F.lit(False)).alias("in_old"), F.coalesce(F.max("in_new"), F.lit(False)).alias("in_new"), F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type")
    )


def read_mapping(mapping: DataFrame) -> DataFrame:
    """Distinct (canonical, source, scope) without case and outer blanks; scope null means every dataset."""
    return mapping.select(F.upper(strip(F.col("canonical"))).alias("canonical"), F.upper(strip(F.col("source"))).alias("source"), strip(F.col("scope")).alias("scope")).filter("canonical <> '' AND source <> ''").distinct()


def _canonicals(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("canonical", F.col("source").alias("__source"), "scope")
    key = F.upper(strip(F.col("field")))
    return fields.join(m, (key == F.col("__source")) & (F.col("scope").isNull() | (F.col("scope") == F.col("dataset")))).select("file_id", "field", "canonical").distinct()


def rename_candidates(fields: DataFrame, diff: DataFrame, mapping: DataFrame, *, agreement: float = 0.9, least_shared: int = 2) -> DataFrame:
    """Weighted candidate renames (file_id, old_field, new_field, weight).

    A pair is a candidate when the mapping knows both as sources of one canonical feature in the dataset or for all
    datasets, or when both files are of one wave, at least ``least_shared`` of their common subjects have a value in
    both fields and a share of ``agreement`` of those carries the same. The value test is a hash join on (file,
    subject, value), so only pairs that agree somewhere are ever formed; repeated records of a subject count once.
    """
    gone = diff.filter("in_old AND NOT in_new").select("file_id", "prev_file_id", "dataset", "same_wave", "field", F.col("old_type").alias("type"))
    new = diff.filter("in_new AND NOT in_old").select("file_id", "dataset", "same_wave", "field", F.col("new_type").alias("type"))
    mapped = (
        _canonicals(gone, mapping).withColumnRenamed("field", "old_field").join(_canonicals(new, mapping).withColumnRenamed("field", "new_field"), ["file_id", "canonical"]).select("file_id", "old_field", "new_field").distinct()
    )
    # the values of vanished and new fields only, read in one pass and written once, as both joins below need them
    wanted = gone.filter("same_wave").select(F.col("prev_file_id").alias("of_file"), "field", "file_id", F.lit(True).alias("is_old"))
    wanted = wanted.unionByName(new.filter("same_wave").select(F.col("file_id").alias("of_file"), "field", "file_id", F.lit(False).alias("is_old")))
    valued = fields.filter(F.col("type").isNotNull() & F.col("subject_key").isNotNull()).select(F.col("file_id").alias("of_file"), "field", "subject_key", "canon")
    values = cut(valued.join(wanted, ["of_file", "field"]).groupBy("file_id", "is_old", "field", "subject_key").agg(F.min("canon").alias("canon")))
    old_values = values.filter("is_old").select("file_id", F.col("field").alias("old_field"), "subject_key", "canon")
    new_values = values.filter("NOT is_old").select("file_id", F.col("field").alias("new_field"), "subject_key", "canon")
    agree = old_values.join(new_values, ["file_id", "subject_key", "canon"]).groupBy("file_id", "old_field", "new_field").agg(F.count(F.lit(1)).alias("agree"))
    agree = cut(agree.filter(F.col("agree") >= least_shared))
    shared = (
        agree.select("file_id", "old_field", "new_field").join(old_values.drop("canon"), ["file_id", "old_field"]).join(new_values.drop("canon"), ["file_id", "new_field", "subject_key"]).groupBy("file_id", "old_field", "new_field").agg(F.count(F.lit(1)).alias("shared"))
    )
    valued = agree.join(shared, ["file_id", "old_field", "new_field"]).filter(F.col("agree") >= agreement * F.col("shared")).select("file_id", "old_field", "new_field", (F.col("agree") / F.col("shared")).alias("share"))
    edges = mapped.withColumn("share", F.lit(None).cast("double")).withColumn("known", F.lit(1.0)).unionByName(valued.withColumn("known", F.lit(None).cast("double")))
    edges = edges.groupBy("file_id", "old_field", "new_field").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("known"), F.lit(0.0)).alias("known"))
    types = lambda side, name: side.select("file_id", F.col("field").alias(name), F.col("type").alias(f"{name}_type"))
    edges = edges.join(types(gone, "old_field"), ["file_id", "old_field"]).join(types(new, "new_field"), ["file_id", "new_field"])
    a, b = F.upper(strip(F.col("old_field"))), F.upper(strip(F.col("new_field")))
    likeness = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    same_type = (F.col("old_field_type") == F.col("new_field_type")).cast("double")
    return edges.select("file_id", "old_field", "new_field", (4 * F.col("share") + 2 * F.col("known") + likeness + 0.25 * F.coalesce(same_type, F.lit(0.0)) + 0.01).alias("weight"))


def schema_changes(records: DataFrame, mapping: DataFrame, *, fields: DataFrame | None = None, **options) -> DataFrame:
    """(file_id, change_kind, old_field, new_field) of every file against the preceding file of its series.

    ``renamed``, ``retyped`` (kept or renamed field whose majority type differs), ``removed`` (new_field is '') and
    ``added`` (old_field is ''). A payload that is no JSON object has no fields, but its file still counts; a field whose values
    are all null has no type and is never retyped; series of one file have no change; an empty table gives none. ``fields``
    are the records' parsed fields (:func:`read_fields`), where a caller has them already; payloads are parsed once.
    """
    if fields is None:
        fields = cut(read_fields(records.filter(F.col("file_id").isNotNull())))
    # written once: one row per file and field, small beside the records
    diff = cut(field_steps(cut(profile_fields(fields)), cut(file_steps(records))))
    edges = cut(rename_candidates(fields, diff, read_mapping(mapping), **options))
    renamed = cut(best_matching(edges, "file_id").select("file_id", "old_field", "new_field"))
    old_of = renamed.select("file_id", F.col("old_field").alias("field"), F.col("new_field").alias("went_to"))
    new_of = renamed.select("file_id", F.col("new_field").alias("field"), F.col("old_field").alias("came_from"))
    state = diff.join(old_of, ["file_id", "field"], "left").join(new_of, ["file_id", "field"], "left")
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    f, none = F.col("field"), F.lit("")
    simple = state.select(
        "file_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("in_old") & F.col("in_new") & (F.col("old_type") != F.col("new_type")), change("retyped", f, f)),
                    F.when(F.col("in_old") & ~F.col("in_new") & F.col("went_to").isNull(), change("removed", f, none)),
                    F.when(F.col("in_new") & ~F.col("in_old") & F.col("came_from").isNull(), change("added", none, f)),
                    F.when(F.col("went_to").isNotNull(), change("renamed", f, F.col("went_to"))),
                )
            )
        ).alias("x"),
    ).select("file_id", "x.*")
    types = diff.select("file_id", "field", "old_type", "new_type")
    retyped = (
        renamed.join(types.select("file_id", F.col("field").alias("old_field"), "old_type"), ["file_id", "old_field"])
        .join(types.select("file_id", F.col("field").alias("new_field"), "new_type"), ["file_id", "new_field"])
        .filter(F.col("old_type") != F.col("new_type"))
        .select("file_id", F.lit("retyped").alias("change_kind"), "old_field", "new_field")
    )
    return simple.unionByName(retyped)


def field_lineage(records: DataFrame, mapping: DataFrame, changes: DataFrame, fields: DataFrame) -> DataFrame:
    """(file_id, field, unified): the one name under which a field's values stand in the consistent table.

    A mapped field takes its canonical name (the first in the alphabet if several); any other takes the name its
    earliest ancestor in the series had, followed through renames. Works on the fields of files, not on records.
    """
    present = fields.select("file_id", "dataset", "field").distinct()
    named = _canonicals(present, read_mapping(mapping)).groupBy("file_id", "field").agg(F.min("canonical").alias("canonical"))
    steps = file_steps(records).select("file_id", "cohort_id", "dataset", "file_seq")
    renamed = changes.filter(F.col("change_kind") == "renamed").select("file_id", F.col("new_field").alias("field"), "old_field")
    rows = steps.join(present.drop("dataset"), "file_id").join(named, ["file_id", "field"], "left").join(renamed, ["file_id", "field"], "left")

    def follow(pdf):
        import pandas as pd

        names: dict[str, str] = {}
        out = []
        for (_, file_id), own in pdf.sort_values(["file_seq", "file_id"]).groupby(["file_seq", "file_id"], sort=True, dropna=False):
            now = {}
            for field, canonical, old in zip(own["field"], own["canonical"], own["old_field"]):
                origin = old if isinstance(old, str) else field
                now[field] = canonical if isinstance(canonical, str) else names.get(origin, origin)
                out.append((file_id, field, now[field]))
            names |= now
        return pd.DataFrame(out, columns=["file_id", "field", "unified"])

    return rows.groupBy("cohort_id", "dataset").applyInPandas(follow, "file_id long, field string, unified string")


def unify_records(records: DataFrame, mapping: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All records in one table: meta columns, one text column per canonical feature, other fields in ``other_fields``.

    Values are written canonically (:func:`with_canonical_value`), so one feature is typed alike in every file. Two fields
    of a record under one unified name keep the value that sorts first. Records without a readable payload stay,
    with nulls. The canonical features are as many as the dictionary lists, a bound set by its width.
    """
    parsed = cut(read_fields(records.filter(F.col("file_id").isNotNull())))
    if changes is None:
        changes = schema_changes(records, mapping, fields=parsed)
    lineage = cut(field_lineage(records, mapping, cut(changes), parsed))
    wide = sorted(r[0] for r in read_mapping(mapping).select("canonical").distinct().collect())
    unified = parsed.select("record_id", "file_id", "field", "canon").join(lineage, ["file_id", "field"])
    known = F.col("unified").isin(wide)
    values = unified.groupBy("record_id").agg(
        *(F.min(F.when(F.col("unified") == c, F.col("canon"))).alias(c.lower()) for c in wide),
        F.array_sort(F.collect_set(F.when(~known & F.col("canon").isNotNull(), F.concat_ws("=", "unified", "canon")))).alias("__other"),
    )
    out = records.select("record_id", *META, "subject_key").join(values, "record_id", "left")
    return out.select("record_id", *META, "subject_key", *(c.lower() for c in wide), F.concat_ws(";", F.coalesce("__other", F.array().cast("array<string>"))).alias("other_fields"))
