"""Queries of the table operators over the project's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.exprs import family_key, not_nan, quoted
from panelforge.operators import aggregate, clean, encode, impute, joins, project, reshape, sentinels
from panelforge.plans.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
SCORES = ("depressive_score", "anxiety_score", "sleep_score")
SCORE_CODES = (-9, -8, -1, 999)
_FAM = "CASE WHEN upper(trim(mcsid)) NOT IN ('', 'NAN', 'UNKNOWN', 'N/A') THEN upper(trim(mcsid)) END"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Floating results rounded, since sums in another order differ in the last bits."""
    return df.select(*(F.round(quoted(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(quoted(f.name)) for f in df.schema))


def score(name: str) -> str:
    return f"CASE WHEN NOT isnan({name}) THEN {name} END"


def clean_panel(spark: SparkSession, d: str) -> DataFrame:
    """The long panel with missing codes and NaN as null."""
    panel = sentinels.replace_sentinels(table(spark, d, "panel_long"), {c: SCORE_CODES for c in SCORES})
    return panel.select(*(not_nan(F.col(c)).alias(c) if c in SCORES else c for c in panel.columns))


_CLEAN = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN NOT isnan({c}) AND {c} NOT IN (-9, -8, -1, 999) THEN {c} END AS {c}" for c in SCORES) + ") FROM panel_long"


# ---- flagship: orders as a panel of yearly waves -----------------------------------------------------------------
def orders_panel(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") - 1994).alias("wave"), "o_totalprice")
    return o.groupBy("o_custkey", "wave").agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n_orders"))


_ORDERS_PANEL = "SELECT o_custkey, CAST(year(o_orderdate) - 1994 AS int) AS wave, avg(o_totalprice) AS price, count(*) AS n_orders FROM orders GROUP BY 1, 2"


@query(f"SELECT o_custkey, wave, round(price, 7) AS price, n_orders FROM ({_ORDERS_PANEL})")
def long_panel_orders(spark, d):
    return rounded(orders_panel(spark, d))


_WIDE_PRICE = ", ".join(f"max(price) FILTER (wave = {w}) AS price_w{w}" for w in range(1, 8))


@query(
    f"""WITH p AS ({_ORDERS_PANEL}), w AS (SELECT o_custkey, {_WIDE_PRICE} FROM p GROUP BY 1), s AS (SELECT o_custkey, avg(price) AS price_mean, max(n_orders) AS n_orders_max FROM p GROUP BY 1)
    SELECT o_custkey, {", ".join(f"round(price_w{w}, 7) AS price_w{w}" for w in range(1, 8))}, round(price_mean, 7) AS price_mean, n_orders_max, c_mktsegment, c_nationkey
    FROM w JOIN s USING (o_custkey) LEFT JOIN customer ON o_custkey = c_custkey"""
)
def flagship(spark, d):
    """Wide panel of orders with row statistics and static customer columns."""
    panel = orders_panel(spark, d)
    wide = reshape.pivot_long_to_wide(panel.drop("n_orders"), ["o_custkey"], "wave", time_label="w", times=range(1, 8), validate=False)
    stats = panel.groupBy("o_custkey").agg(F.avg("price").alias("price_mean"), F.max("n_orders").alias("n_orders_max"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return rounded(joins.join_roles(wide, [(stats, ["o_custkey"], "stats"), (customers, ["o_custkey"], "customer")], validate=False))


# ---- aggregation -------------------------------------------------------------------------------------------------
_AGG = {"mean": "avg({0})", "median": "median({0})", "min": "min({0})", "max": "max({0})", "std": "stddev_samp({0})"}
for _how, _sql in _AGG.items():

    def _run(spark, d, how=_how):
        return rounded(aggregate.aggregate_to_cross_section(clean_panel(spark, d), "subject_id", numeric_cols=SCORES, numeric_agg=how))

    query(f"SELECT subject_id, {', '.join('round(' + _sql.format(c) + f', 7) AS {c}' for c in SCORES)} FROM ({_CLEAN}) GROUP BY 1", f"agg_{_how}")(_run)


@query(
    "WITH c AS (SELECT centre_id, site_label, count(*) AS n FROM panel_long WHERE site_label IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY n DESC, site_label) AS k FROM c) "
    "SELECT p.centre_id, site_label FROM (SELECT DISTINCT centre_id FROM panel_long) p LEFT JOIN (SELECT centre_id AS c, site_label FROM r WHERE k = 1) ON p.centre_id IS NOT DISTINCT FROM c"
)
def agg_mode(spark, d):
    return aggregate.aggregate_to_cross_section(table(spark, d, "panel_long"), "centre_id", numeric_cols=[], categorical_cols=["site_label"])


for _how, _pick in (("first", "min_by"), ("last", "max_by")):

    def _run(spark, d, how=_how):
        return aggregate.aggregate_to_cross_section(table(spark, d, "panel_long"), "centre_id", numeric_cols=[], categorical_cols=["site_label"], categorical_agg=how, order="obs_id")

    query(f"SELECT centre_id, {_pick}(site_label, obs_id) FILTER (site_label IS NOT NULL) AS site_label FROM panel_long GROUP BY 1", f"agg_{_how}")(_run)


@query("SELECT count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS bigint) AS duplicate_rows FROM (SELECT subject_id, wave, count(*) AS n FROM panel_long GROUP BY 1, 2)")
def duplicate_keys(spark, d):
    return aggregate.duplicate_rows(table(spark, d, "panel_long"), ["subject_id", "wave"])


@query(f"SELECT subject_id, NOT bool_or(depressive_score IS NULL OR anxiety_score IS NULL OR sleep_score IS NULL) AS is_complete FROM ({_CLEAN}) GROUP BY 1")
def complete_subjects(spark, d):
    return aggregate.complete_subjects(clean_panel(spark, d), "subject_id", SCORES)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (k > 1 OR (k = 1 AND m < n)) AS groups_varying FROM (SELECT subject_id, count(DISTINCT {c}) AS k, count({c}) AS m, count(*) AS n FROM subjects GROUP BY 1)"
        for c in ("sex_label", "cnum", "age_baseline", "mcsid")
    )
)
def invariance_violations(spark, d):
    return aggregate.varying_columns(table(spark, d, "subjects"), ["subject_id"], ["sex_label", "cnum", "age_baseline", "mcsid"])


@query("SELECT CAST(sum((CASE WHEN mcsid IS NULL THEN 1 ELSE 0 END) + (CASE WHEN pnum IS NULL THEN 1 ELSE 0 END) + (CASE WHEN person_id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN first_wave IS NULL THEN 1 ELSE 0 END) + (CASE WHEN apgehe00 IS NULL OR isnan(apgehe00) THEN 1 ELSE 0 END)) AS bigint) AS missing_cells, count(*) AS n_rows FROM parents")
def missing_cells(spark, d):
    return aggregate.missing_cells(table(spark, d, "parents"))


@query(f"SELECT obs_id, (depressive_score IS NULL)::bigint + (anxiety_score IS NULL)::bigint + (sleep_score IS NULL)::bigint AS missing_feature_count FROM ({_CLEAN})")
def row_missing_count(spark, d):
    return aggregate.with_missing_count(clean_panel(spark, d), SCORES).select("obs_id", "missing_feature_count")


_ASSIGNED = "(SELECT DISTINCT ON (s) CAST(try_cast(trim(subject_id) AS double) AS bigint) AS s, trajectory_id FROM trajectory_assignments WHERE try_cast(trim(subject_id) AS double) IS NOT NULL ORDER BY s, assign_id)"


def _labelled_panel(spark, d):
    t = table(spark, d, "trajectory_assignments").withColumn("s", F.expr("try_cast(try_cast(trim(subject_id) AS double) AS bigint)")).filter("s IS NOT NULL")
    t = reshape.keep_first(t, ["s"], ["assign_id"]).select("s", "trajectory_id")
    return clean_panel(spark, d).join(t, F.col("subject_id") == F.col("s"))


_LABELLED = f"SELECT p.*, t.trajectory_id FROM ({_CLEAN}) p JOIN {_ASSIGNED} t ON p.subject_id = t.s"


@query(f"SELECT trajectory_id AS trajectory, wave AS time, round(avg(depressive_score), 7) AS mean, round(coalesce(stddev_samp(depressive_score), 0), 7) AS std, count(*) AS n, round(coalesce(stddev_samp(depressive_score), 0) / sqrt(count(*)), 7) AS sem FROM ({_LABELLED}) WHERE depressive_score IS NOT NULL AND trajectory_id IS NOT NULL AND wave IS NOT NULL GROUP BY 1, 2")
def class_profile_sem(spark, d):
    return rounded(aggregate.class_time_profile(_labelled_panel(spark, d), "trajectory_id", "wave", "depressive_score"))


@query(f"WITH o AS (SELECT subject_id, min(trajectory_id) AS trajectory FROM ({_LABELLED}) WHERE trajectory_id IS NOT NULL GROUP BY 1) SELECT trajectory, count(*) AS n_subjects, round(count(*) / (SELECT count(*) FROM o), 7) AS share FROM o GROUP BY 1")
def class_sizes(spark, d):
    return rounded(aggregate.class_sizes(_labelled_panel(spark, d), "subject_id", "trajectory_id"))


@query(f"SELECT subject_id, wave, {', '.join(f'round(avg({c}), 7) AS {c}' for c in SCORES)} FROM ({_CLEAN}) GROUP BY 1, 2")
def mean_curves(spark, d):
    return rounded(aggregate.mean_curves(clean_panel(spark, d), "subject_id", "wave", SCORES))


@query(f"SELECT subject_id, count(*) AS n, CAST(sum(wave) AS double) AS st, CAST(sum(wave * wave) AS double) AS stt, round(sum(depressive_score), 7) AS sy, round(sum(wave * depressive_score), 7) AS sty, round(sum(depressive_score * depressive_score), 7) AS syy FROM ({_CLEAN}) WHERE depressive_score IS NOT NULL AND subject_id IS NOT NULL AND wave IS NOT NULL GROUP BY 1")
def suff_stats_growth(spark, d):
    return rounded(aggregate.growth_statistics(clean_panel(spark, d), "subject_id", "wave", "depressive_score"))


@query(f"SELECT trajectory_id AS class, round(regr_intercept(depressive_score, wave), 7) AS intercept, round(regr_slope(depressive_score, wave), 7) AS slope FROM ({_LABELLED}) WHERE depressive_score IS NOT NULL AND trajectory_id IS NOT NULL GROUP BY 1")
def weighted_growth_line(spark, d):
    return rounded(aggregate.weighted_lines(_labelled_panel(spark, d), "trajectory_id", "wave", "depressive_score"))


@query("SELECT sex_label AS value, count(*) AS n FROM subjects GROUP BY 1")
def value_counts(spark, d):
    return aggregate.value_counts(table(spark, d, "subjects"), "sex_label")


# ---- reshape -----------------------------------------------------------------------------------------------------
@query(f"SELECT o_custkey, {', '.join(f'round(max(price) FILTER (wave = {w}), 7) AS price_w{w}, max(n_orders) FILTER (wave = {w}) AS n_orders_w{w}' for w in range(1, 8))} FROM ({_ORDERS_PANEL}) GROUP BY 1")
def pivot_orders_by_year(spark, d):
    return rounded(reshape.pivot_long_to_wide(orders_panel(spark, d), ["o_custkey"], "wave", time_label="w", times=range(1, 8)))


@query(
    f"WITH p AS ({_ORDERS_PANEL}) SELECT o_custkey, any_value(c_mktsegment) AS c_mktsegment, {', '.join(f'round(max(price) FILTER (wave = {w}), 7) AS price_t{w}' for w in range(1, 8))} FROM p JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)
def pivot_with_static(spark, d):
    panel = orders_panel(spark, d).drop("n_orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rounded(reshape.pivot_long_to_wide(panel, ["o_custkey"], "wave", static=["c_mktsegment"]))


@query("SELECT user_id, round(max(v) FILTER (t = 0), 7) AS \"value-t0\", round(max(v) FILTER (t = 0.5), 7) AS \"value-t0p5\" FROM (SELECT user_id, CASE WHEN hour(ts) < 12 THEN 0.0 ELSE 0.5 END AS t, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def pivot_time_token(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.when(F.hour("ts") < 12, 0.0).otherwise(0.5).alias("half")).agg(F.avg("value").alias("value"))
    return rounded(reshape.pivot_long_to_wide(e, ["user_id"], "half", separator="-", validate=False))


_EMOTION = {2: "emotion_w2", 3: "emotion_w3", 4: "emotion_w4", 6: "emotion_w6", 7: "emotion_w7"}
_OEDE = {1: "adoede00_w1", 2: "adoede00_w2", 3: "adoede00_w3", 5: "adoede00_w5"}


@query(
    "WITH w AS (SELECT * FROM wide_features), l AS ("
    + " UNION ALL ".join(f"SELECT row_id, {t} AS wave, {score(_EMOTION[t]) if t in _EMOTION else 'NULL'} AS emotion, {score(_OEDE[t]) if t in _OEDE else 'NULL'} AS adoede00 FROM w" for t in range(1, 8))
    + ") SELECT * FROM l WHERE emotion IS NOT NULL OR adoede00 IS NOT NULL"
)
def unpivot_wide(spark, d):
    wide = table(spark, d, "wide_features")
    wide = wide.select("row_id", *(not_nan(F.col(c)).alias(c) for c in [*_EMOTION.values(), *_OEDE.values()]))
    return reshape.unpivot_wide(wide, ["row_id"], {"emotion": _EMOTION, "adoede00": _OEDE})


@query(
    f"SELECT family, {', '.join(f'(arg_min(first_wave, parent_row_id) FILTER (pnum = {k} AND first_wave IS NOT NULL)) AS p{k}__first_wave, (arg_min(person_id, parent_row_id) FILTER (pnum = {k} AND person_id IS NOT NULL)) AS p{k}__person_id' for k in (1, 2, 3))} FROM (SELECT *, {_FAM} AS family FROM parents) GROUP BY 1"
)
def pivot_parent_slots(spark, d):
    parents = table(spark, d, "parents").withColumn("family", family_key(F.col("mcsid")))
    return reshape.pivot_slots(parents, ["family"], project.slot_label(F.col("pnum")), ["p1", "p2", "p3"], ["first_wave", "person_id"], ["parent_row_id"])


@query("WITH a AS (SELECT DISTINCT mcsid, cnum FROM subjects WHERE mcsid IS NOT NULL AND cnum IS NOT NULL), b AS (SELECT DISTINCT mcsid, cnum FROM child_parent_link WHERE mcsid IS NOT NULL AND cnum IS NOT NULL) SELECT * FROM a UNION SELECT * FROM b")
def anchor_union(spark, d):
    return reshape.union_keys([table(spark, d, "subjects"), table(spark, d, "child_parent_link")], ["mcsid", "cnum"])


@query(
    "SELECT row_id AS id, chid, sex_label, CAST(NULL AS varchar) AS first_wave FROM subjects UNION ALL SELECT parent_row_id, NULL, NULL, first_wave FROM parents"
)
def wave_union_by_name(spark, d):
    return reshape.union_by_name([table(spark, d, "subjects").select(F.col("row_id").alias("id"), "chid", "sex_label"), table(spark, d, "parents").select(F.col("parent_row_id").alias("id"), "first_wave")])


@query("SELECT * EXCLUDE (k) REPLACE (" + ", ".join(f"{score(c)} AS {c}" for c in SCORES) + ") FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, wave ORDER BY loaded_at NULLS LAST, obs_id) AS k FROM panel_long) WHERE k = 1")
def keep_first(spark, d):
    """The row delivered first for each subject and wave, NaN as null."""
    kept = reshape.keep_first(table(spark, d, "panel_long"), ["subject_id", "wave"], ["loaded_at", "obs_id"])
    return kept.select(*(not_nan(F.col(c)).alias(c) if c in SCORES else c for c in kept.columns))


@query("SELECT subject_id, wave, obs_id FROM panel_long ORDER BY subject_id NULLS FIRST, wave")
def long_output_order(spark, d):
    return reshape.sort_long(table(spark, d, "panel_long").select("subject_id", "wave", "obs_id"), "subject_id", "wave")


@query(
    f"SELECT subject_id, arg_min(site_label, {{'w': wave, 's': site_label}}) FILTER (site_label IS NOT NULL) AS site_label, {', '.join(f'round(min({c}) FILTER (wave = {w}), 7) AS {c}_w{w}' for c in SCORES for w in range(1, 8))} FROM ({_CLEAN}) GROUP BY 1"
)
def waves_to_wide(spark, d):
    return rounded(reshape.waves_to_wide(clean_panel(spark, d), "subject_id", "wave", range(1, 8), SCORES, ["site_label"]))


# ---- joins -------------------------------------------------------------------------------------------------------
_T = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY assign_id) AS k FROM trajectory_assignments WHERE subject_id IS NOT NULL) WHERE k = 1)"


def _combine(spark, d, how):
    return joins.combine_with_trajectories(
        table(spark, d, "subjects").select("row_id", "subject_id", "chid"), table(spark, d, "trajectory_assignments"), "subject_id", "subject_id", columns=["trajectory_id", "trajectory_name"], how=how, order=["assign_id"]
    )


_COMBINE = "SELECT row_id, s.subject_id, chid, trajectory_id, trajectory_name FROM subjects s {0} JOIN (SELECT trim(subject_id) AS x, * EXCLUDE (subject_id) FROM " + _T + ") t ON CAST(s.subject_id AS varchar) = t.x"


@query(_COMBINE.format("LEFT"))
def combine_left(spark, d):
    return _combine(spark, d, "left")


@query(_COMBINE.format("INNER"))
def combine_inner(spark, d):
    return _combine(spark, d, "inner")


@query("SELECT count(*) FILTER (trajectory_id IS NULL AND trajectory_name IS NULL) AS unmatched_rows, count(*) AS n_rows FROM (" + _COMBINE.format("LEFT") + ")")
def combine_unmatched(spark, d):
    return joins.unmatched_rows(_combine(spark, d, "left"), ["trajectory_id", "trajectory_name"])


@query("SELECT l.*, r.wave AS wave_trajectory FROM (SELECT link_id, wave, cnum FROM child_parent_link) l LEFT JOIN (SELECT cnum, arg_min(wave, link_id) AS wave FROM child_parent_link WHERE cnum IS NOT NULL GROUP BY 1) r ON l.cnum = r.cnum")
def combine_suffix(spark, d):
    link = table(spark, d, "child_parent_link")
    return joins.combine_with_trajectories(link.select("link_id", "wave", "cnum"), link.select("cnum", "wave", "link_id"), "cnum", "cnum", columns=["wave"], order=["link_id"])


@query(
    f"""WITH a AS (SELECT DISTINCT {_FAM} AS family, cnum FROM subjects WHERE {_FAM} IS NOT NULL AND cnum > 0),
    c AS (SELECT {_FAM} AS family, cnum, min(age_baseline) AS child__age FROM subjects GROUP BY 1, 2),
    f AS (SELECT {_FAM} AS family, count(*) AS family__parents FROM parents GROUP BY 1),
    p AS (SELECT {_FAM} AS family, min(person_id) FILTER (pnum = 1) AS p1__person FROM parents GROUP BY 1)
    SELECT a.family, a.cnum, a.family || '_' || a.cnum AS chid, child__age, family__parents, p1__person FROM a LEFT JOIN c ON a.family = c.family AND a.cnum = c.cnum LEFT JOIN f ON a.family = f.family LEFT JOIN p ON a.family = p.family"""
)
def role_join(spark, d):
    """Anchor of children, one-to-one child columns, many-to-one family columns, pivoted parent columns."""
    child = table(spark, d, "subjects").withColumn("family", family_key(F.col("mcsid")))
    parent = table(spark, d, "parents").withColumn("family", family_key(F.col("mcsid")))
    anchor = reshape.union_keys([child.filter("cnum > 0")], ["family", "cnum"])
    own = project.prefix_columns(child.groupBy("family", "cnum").agg(F.min("age_baseline").alias("age")), "child", ["family", "cnum"])
    family = project.prefix_columns(parent.groupBy("family").agg(F.count(F.lit(1)).alias("parents")), "family", ["family"])
    slots = reshape.pivot_slots(parent, ["family"], project.slot_label(F.col("pnum")), ["p1"], ["person_id"], ["person_id"]).withColumnRenamed("p1__person_id", "p1__person")
    out = joins.join_roles(anchor, [(own, ["family", "cnum"], "child"), (family, ["family"], "family"), (slots, ["family"], "parent")])
    return out.withColumn("chid", project.child_identifier(F.col("family"), F.col("cnum")))


@query("WITH a AS (SELECT DISTINCT mcsid, cnum FROM subjects WHERE mcsid IS NOT NULL AND cnum IS NOT NULL), b AS (SELECT DISTINCT mcsid, cnum FROM child_parent_link WHERE mcsid IS NOT NULL AND cnum IS NOT NULL) SELECT count(*) AS anchor_rows, count(b.mcsid) AS matched_rows FROM a LEFT JOIN b ON a.mcsid = b.mcsid AND a.cnum = b.cnum")
def merge_coverage(spark, d):
    return joins.coverage(table(spark, d, "subjects"), table(spark, d, "child_parent_link"), ["mcsid", "cnum"])


@query("SELECT link_id FROM child_parent_link l WHERE EXISTS (SELECT 1 FROM parents p WHERE p.mcsid = l.mcsid AND p.pnum = l.pnum)")
def membership_semi(spark, d):
    return table(spark, d, "child_parent_link").join(table(spark, d, "parents"), ["mcsid", "pnum"], "left_semi").select("link_id")


@query("SELECT link_id FROM child_parent_link l WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.mcsid = l.mcsid AND p.pnum = l.pnum)")
def membership_anti(spark, d):
    return table(spark, d, "child_parent_link").join(table(spark, d, "parents"), ["mcsid", "pnum"], "left_anti").select("link_id")


# ---- projections and encodings -----------------------------------------------------------------------------------
@query("SELECT subject_id, chid, cnum, sex_label, age_baseline, registered_at FROM subjects")
def remove_columns(spark, d):
    return project.remove_columns(table(spark, d, "subjects"), ["row_id", "mcsid", "withdrawn_at", "loaded_at"])


@query("SELECT parent_row_id, mcsid, pnum, person_id, first_wave AS entry_wave, apgehe00 FROM parents")
def rename_feature(spark, d):
    return project.rename_feature(table(spark, d, "parents"), "first_wave", "entry_wave")


@query("SELECT link_id, mcsid || '_' || cnum AS chid, CASE WHEN pnum > 0 THEN 'p' || pnum END AS slot FROM child_parent_link")
def identifiers(spark, d):
    return table(spark, d, "child_parent_link").select("link_id", project.child_identifier(F.col("mcsid"), F.col("cnum")).alias("chid"), project.slot_label(F.col("pnum")).alias("slot"))


_IN = ["emotion_w2", "emotion_w3", "emotion_w4", "emotion_w6"]
_LISTED = "list_filter([" + ", ".join(score(c) for c in _IN) + "], lambda x: x IS NOT NULL)"
_REDUCE = {"sum": "list_sum({0})", "mean": "list_avg({0})", "median": "list_median({0})", "min": "list_min({0})", "max": "list_max({0})", "coalesce": "{0}[1]"}
for _how, _sql in _REDUCE.items():

    def _run(spark, d, how=_how):
        wide = table(spark, d, "wide_features")
        return rounded(wide.select("row_id", encode.reduce_row(wide, _IN, how).alias("composite")))

    query(f"SELECT row_id, round({_sql.format(_LISTED)}, 7) AS composite FROM wide_features", f"composite_{_how}")(_run)


@query(f"SELECT row_id, coalesce({', '.join(score(c) for c in _IN)}) AS emotion, coalesce({score('apgehe00_w1')}, {score('apgehe00_w2')}) AS apgehe00 FROM wide_features")
def coalesce_canonical(spark, d):
    wide = table(spark, d, "wide_features")
    wide = wide.select("row_id", *(not_nan(F.col(c)).alias(c) for c in [*_IN, "apgehe00_w1", "apgehe00_w2"]))
    return encode.coalesce_family(wide, {"emotion": _IN, "apgehe00": ["apgehe00_w1", "apgehe00_w2"]})


@query("SELECT row_id, CAST(CASE WHEN non_long__w1__ahcsex00 = 1 THEN 0 WHEN non_long__w1__ahcsex00 = 2 THEN 1 END AS double) AS sex, CAST(CASE WHEN apdean00_w1 = 1 THEN 1 WHEN apdean00_w1 = 2 THEN 0 END AS double) AS apdean00_w1 FROM wide_features")
def encode_binary(spark, d):
    wide = table(spark, d, "wide_features")
    return wide.select("row_id", encode.binary(wide, "non_long__w1__ahcsex00", {1: 0, 2: 1}).alias("sex"), encode.binary(wide, "apdean00_w1", {1: 1, 2: 0}).alias("apdean00_w1"))


@query("SELECT row_id, CAST(nullif(list_position([1.0, 2.0, 3.0, 4.0, 5.0, 95.0], try_cast(trim(adacaq00_w3) AS double)), 0) AS double) AS qualification, CASE WHEN NOT isnan(apgehe00_w1) THEN apgehe00_w1 END AS apgehe00_w1 FROM wide_features")
def encode_ordinal_rank(spark, d):
    wide = table(spark, d, "wide_features")
    return wide.select("row_id", encode.ordinal(wide, "adacaq00_w3", [1, 2, 3, 4, 5, 95]).alias("qualification"), encode.ordinal(wide, "apgehe00_w1").alias("apgehe00_w1"))


@query(
    "SELECT row_id, " + ", ".join(f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN CAST({c} = {v} AS int)::double END AS {n}" for c, v, n in [("adroow00_w1", v, f"adroow00__v{v}_w1") for v in (1, 2, 3)] + [("non_long__w1__adc06e00", v, f"non_long__w1__adc06e00__v{v}") for v in (1, 2)]) + " FROM wide_features"
)
def encode_one_hot(spark, d):
    wide = table(spark, d, "wide_features").select("row_id", "adroow00_w1", "non_long__w1__adc06e00")
    return encode.one_hot(wide, {"adroow00_w1": [1, 2, 3], "non_long__w1__adc06e00": [1, 2]})


@query("SELECT assign_id, trajectory_name, CAST(dense_rank() OVER (ORDER BY trajectory_name) - 1 AS bigint) AS trajectory_name_code FROM trajectory_assignments WHERE trajectory_name IS NOT NULL UNION ALL SELECT assign_id, NULL, NULL FROM trajectory_assignments WHERE trajectory_name IS NULL")
def label_encode(spark, d):
    return project.label_codes(table(spark, d, "trajectory_assignments").select("assign_id", "trajectory_name"), "trajectory_name")[0]


@query("SELECT o_orderkey, o_orderstatus, " + ", ".join(f"CAST(o_orderstatus = '{x}' AS int) AS traj_{x.lower()}_vs_rest" for x in "FOP") + " FROM orders")
def one_vs_rest_targets(spark, d):
    return project.one_vs_rest(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


# ---- sentinels and profiles --------------------------------------------------------------------------------------
_CODES = ", ".join(map(str, sentinels.SENTINEL_CODES))


@query(f"SELECT row_id, load_id, emotion_w7 FROM wide_features WHERE NOT isnan(emotion_w7) AND emotion_w7 NOT IN ({_CODES})")
def target_row_filter(spark, d):
    return sentinels.target_rows(table(spark, d, "wide_features"), "emotion_w7").select("row_id", "load_id", "emotion_w7")


@query(f"SELECT count(*) AS rows_before, count(*) FILTER (NOT n AND NOT s) AS rows_after, count(*) FILTER (n) AS null_targets, count(*) FILTER (s) AS sentinel_targets, round(count(*) FILTER (n OR s) / count(*), 7) AS removed_share FROM (SELECT emotion_w7 IS NULL OR isnan(emotion_w7) AS n, coalesce(emotion_w7 IN ({_CODES}), false) AS s FROM wide_features)")
def target_row_summary(spark, d):
    return rounded(sentinels.target_row_summary(table(spark, d, "wide_features"), "emotion_w7"))


@query("SELECT obs_id, " + ", ".join(f"CASE WHEN {c} IN (-9, -8, -1, 999) THEN NULL ELSE {c} END AS {c}" for c in SCORES) + " FROM panel_long")
def sentinel_to_null(spark, d):
    return sentinels.replace_sentinels(table(spark, d, "panel_long"), {c: SCORE_CODES for c in SCORES}).select("obs_id", *SCORES)


_WIDE_COLS = ["apgehe00_w1", "emotion_w2", "adacaq00_w3", "area_code_w1"]
_NUM = "CASE WHEN NOT isnan(try_cast(trim(CAST({0} AS varchar)) AS double)) THEN try_cast(trim(CAST({0} AS varchar)) AS double) END"


@query(f"SELECT column_name, CAST(v AS bigint) AS code, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {_NUM.format(c)} AS v FROM wide_features" for c in _WIDE_COLS)}) WHERE v IN ({_CODES}) GROUP BY 1, 2")
def observed_sentinels(spark, d):
    return sentinels.observed_codes(table(spark, d, "wide_features"), _WIDE_COLS)


@query(
    "SELECT DISTINCT column_name, CAST(regexp_extract(v, '(-?[0-9]+)', 1) AS bigint) AS code FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, lower({c}) AS v FROM wide_features" for c in ("adacaq00_w3", "area_code_w1", "interview_month_w2"))
    + ") WHERE regexp_matches(v, 'refused|not applicable|missing|don.t know|not asked|not answered') AND regexp_matches(v, '[0-9]')"
)
def labelled_sentinels(spark, d):
    return sentinels.label_codes(table(spark, d, "wide_features"), ["adacaq00_w3", "area_code_w1", "interview_month_w2", "emotion_w2"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IN (-9, -8, -1, 999)) AS replaced FROM panel_long" for c in SCORES))
def sentinel_replacements(spark, d):
    return sentinels.replacement_counts(table(spark, d, "panel_long"), {c: SCORE_CODES for c in SCORES})


def _profile_sql(c: str, dtype: str) -> str:
    na = f"({c} IS NULL OR isnan({c}))" if dtype == "double" else f"({c} IS NULL)"
    num = c if dtype == "double" else f"try_cast(trim({c}) AS double)"
    return (
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({na}) AS na_count, count(*) FILTER ({na} OR coalesce({num} IN ({_CODES}), false)) AS effective_missing_count, "
        f"round(count(*) FILTER ({na} OR coalesce({num} IN ({_CODES}), false)) / count(*), 7) AS effective_missing_rate, count(*) FILTER (NOT ({na} OR coalesce({num} IN ({_CODES}), false))) AS valid_count, "
        f"count(DISTINCT {c}) FILTER (NOT ({na} OR coalesce({num} IN ({_CODES}), false))) AS nunique_valid, '{dtype}' AS dtype FROM wide_features"
    )


_PROFILED = {"apgehe00_w1": "double", "emotion_w2": "double", "adoede00_w1": "double", "adacaq00_w3": "string", "area_code_w1": "string"}


@query(" UNION ALL ".join(_profile_sql(c, k) for c, k in _PROFILED.items()))
def column_profile(spark, d):
    return rounded(clean.profile_columns(table(spark, d, "wide_features"), list(_PROFILED), sentinels.SENTINEL_CODES))


# ---- correlation -------------------------------------------------------------------------------------------------
_CORR = ("depressive_score", "anxiety_score", "sleep_score")


def _spearman_sql() -> str:
    parts = []
    for i, a in enumerate(sorted(_CORR)):
        for b in sorted(_CORR)[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(corr(rx, ry), 7) AS rho, round(abs(corr(rx, ry)), 7) AS abs_rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx, "
                f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry FROM ({_CLEAN}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            )
    return " UNION ALL ".join(parts)


@query(_spearman_sql())
def spearman_pairs(spark, d):
    return rounded(clean.spearman_pairs(clean_panel(spark, d), _CORR))


@query(None)
def correlation_prune(spark, d):
    panel = clean_panel(spark, d)
    pairs = [(r["feature_a"], r["feature_b"], r["abs_rho"]) for r in clean.spearman_pairs(panel, _CORR, threshold=0.3).collect()]
    rates = {r["column_name"]: r["effective_missing_rate"] for r in clean.profile_columns(panel, _CORR).collect()}
    return spark.createDataFrame(clean.prune_correlated(pairs, rates), "dropped string, kept string, reason string, abs_rho double")


# ---- imputation and cleaning -------------------------------------------------------------------------------------
for _name, _fill in (("mean", "avg({0})"), ("median", "median({0})")):

    def _run(spark, d, how=_name):
        return rounded(impute.impute(clean_panel(spark, d).select("obs_id", *SCORES), f"{how}_imputation", columns=SCORES))

    query(f"WITH c AS ({_CLEAN}) SELECT obs_id, {', '.join(f'round(coalesce({c}, (SELECT {_fill.format(c)} FROM c)), 7) AS {c}' for c in SCORES)} FROM c", f"impute_{_name}")(_run)


@query("WITH m AS (SELECT sex_label AS v, count(*) AS n FROM subjects WHERE sex_label IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1) SELECT row_id, coalesce(sex_label, (SELECT v FROM m)) AS sex_label FROM subjects")
def impute_most_frequent(spark, d):
    return impute.impute(table(spark, d, "subjects").select("row_id", "sex_label"), "most_frequent_imputation")


@query("SELECT parent_row_id, coalesce(mcsid, 'missing') AS mcsid, coalesce(person_id, 0) AS person_id, CASE WHEN apgehe00 IS NULL OR isnan(apgehe00) THEN 0.0 ELSE apgehe00 END AS apgehe00 FROM parents")
def impute_constant(spark, d):
    return impute.impute(table(spark, d, "parents").select("parent_row_id", "mcsid", "person_id", "apgehe00"), "constant_imputation")


@query("SELECT parent_row_id, CASE WHEN trim(mcsid) NOT IN ('', 'nan', 'n/a') THEN mcsid END AS mcsid, CAST(pnum AS double) AS pnum, CASE WHEN NOT isnan(apgehe00) THEN apgehe00 END AS apgehe00 FROM parents")
def clean_dataset(spark, d):
    raw = table(spark, d, "parents").select("parent_row_id", "mcsid", F.col("pnum").cast("string").alias("pnum"), "apgehe00", F.lit(None).cast("string").alias("empty"))
    return clean.clean_types(raw)


@query(None)
def harmonise_mapping(spark, d):
    return clean.harmonise_categories(table(spark, d, "subjects"), ["sex_label"])[1]


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
