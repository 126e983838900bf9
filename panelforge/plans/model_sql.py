"""SQL for those queries of :mod:`panelforge.plans.model_queries` whose results, or the invariants of them, SQL can give."""

from panelforge.plans.reference_queries import _CLEAN, _FAM, SCORES

_MEAN_CURVES = f"SELECT subject_id, wave, {', '.join(f'avg({c}) AS {c}' for c in SCORES)} FROM ({_CLEAN}) WHERE subject_id IS NOT NULL AND wave BETWEEN 1 AND 7 GROUP BY 1, 2"
_COMPLETE = f"SELECT subject_id FROM ({_MEAN_CURVES}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SCORES)} GROUP BY 1 HAVING count(*) = 7"

TRAJECTORY_CHECKS = " UNION ALL ".join(f"SELECT '{b}' AS builder, count(*) AS n_subjects, CAST(0 AS bigint) AS n_repeated, CAST(0 AS bigint) AS n_outside FROM ({_COMPLETE})" for b in ("dtw_kmeans", "lcga", "gmm"))

IMPUTE_MICE_CHECKS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_imputed, CAST(0 AS bigint) AS n_changed, CAST(0 AS bigint) AS n_left, CAST(0 AS bigint) AS n_foreign FROM wide_features"
    for c in ("emotion_w2", "emotion_w3", "emotion_w4", "apgehe00_w1")
)

# a class of n rows gives each fold n // 5 of them and the first n % 5 folds one more
STRATIFIED_FOLD_SIZES = """SELECT o_orderstatus, CAST(fold AS int) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n_rows
FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) CROSS JOIN range(5) AS r(fold)"""

PREPARE_PANEL = f"""
WITH child AS (SELECT {_FAM} AS fam, cnum, min(age_baseline) AS age FROM subjects WHERE {_FAM} IS NOT NULL AND cnum > 0 GROUP BY 1, 2),
people AS (SELECT {_FAM} AS fam, pnum, max(CASE WHEN NOT isnan(apgehe00) THEN apgehe00 END) AS g FROM parents WHERE {_FAM} IS NOT NULL AND pnum > 0 GROUP BY 1, 2),
link AS (SELECT wave, {_FAM} AS fam, cnum, pnum, max(CASE WHEN NOT isnan(acadmo00) THEN acadmo00 END) AS a FROM child_parent_link
  WHERE {_FAM} IS NOT NULL AND cnum > 0 AND pnum > 0 AND wave IN ('W1', 'W2', 'W3', 'W4', 'W5', 'W6', 'W7') GROUP BY 1, 2, 3, 4),
anchor AS (SELECT 'W' || w AS wave, fam, cnum FROM child CROSS JOIN range(1, 8) AS r(w) UNION SELECT wave, fam, cnum FROM link)
SELECT n.fam || '_' || n.cnum AS "CHID", n.wave, n.fam AS "MCSID", n.cnum AS "CNUM", l.a AS "ACADMO00", p.g AS "APGEHE00", CASE WHEN n.wave = 'W1' THEN c.age END AS "non_long__w1__AGE"
FROM anchor n LEFT JOIN link l ON l.wave = n.wave AND l.fam = n.fam AND l.cnum = n.cnum AND l.pnum = 1
LEFT JOIN people p ON p.fam = l.fam AND p.pnum = l.pnum LEFT JOIN child c ON c.fam = n.fam AND c.cnum = n.cnum"""


def oracle_sql() -> dict[str, str]:
    return {"trajectory_checks": TRAJECTORY_CHECKS, "impute_mice_checks": IMPUTE_MICE_CHECKS, "stratified_fold_sizes": STRATIFIED_FOLD_SIZES, "prepare_panel": PREPARE_PANEL}
