"""SQL that gives the results of :mod:`panelforge.plans.problems` on the same tables."""

_FAMILY = "CASE WHEN upper(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) NOT IN ('', 'NAN', 'UNKNOWN', 'N/A') THEN upper(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) END"

_CHECKED = f"""
WITH s AS (SELECT subject_id, {_FAMILY.format('mcsid')} AS family, CASE WHEN cnum > 0 THEN cnum END AS number, registered_at, withdrawn_at FROM subjects),
own AS (SELECT subject_id, min(registered_at) AS since, min(withdrawn_at) AS until FROM s WHERE subject_id IS NOT NULL GROUP BY 1),
kids AS (
  SELECT family, number, min(since) AS since, CASE WHEN count(until) = count(*) THEN max(until) END AS until
  FROM (SELECT DISTINCT subject_id, family, number FROM s WHERE family IS NOT NULL AND number IS NOT NULL) JOIN own USING (subject_id) GROUP BY 1, 2),
folk AS (SELECT DISTINCT {_FAMILY.format('mcsid')} AS family, pnum AS number FROM parents WHERE pnum > 0),
assigned AS (SELECT *, trim(subject_id) AS t FROM trajectory_assignments),
checked AS (
  SELECT 'panel_long' AS table_name, obs_id AS record_id, 'subject' AS ref_name, observed_at AS "at",
    CASE WHEN p.subject_id IS NULL THEN 'absent' WHEN o.subject_id IS NULL THEN 'missing' WHEN until <= observed_at THEN 'deleted' WHEN since > observed_at THEN 'late' ELSE 'none' END AS cause
  FROM panel_long p LEFT JOIN own o ON p.subject_id = o.subject_id
  UNION ALL
  SELECT 'trajectory_assignments', assign_id, 'subject', assigned_at,
    CASE WHEN t IS NULL OR upper(t) IN ('', 'NA') THEN 'absent' WHEN o.subject_id IS NULL THEN 'missing' WHEN until <= assigned_at THEN 'deleted' WHEN since > assigned_at THEN 'late' ELSE 'none' END
  FROM assigned a LEFT JOIN own o ON try_cast(a.t AS double) = o.subject_id
  UNION ALL
  SELECT 'child_parent_link', link_id, 'child', interviewed_at,
    CASE WHEN l.family IS NULL OR l.cnum IS NULL OR l.cnum <= 0 THEN 'absent' WHEN k.family IS NULL THEN 'missing' WHEN until <= interviewed_at THEN 'deleted' WHEN since > interviewed_at THEN 'late' ELSE 'none' END
  FROM (SELECT *, {_FAMILY.format('mcsid')} AS family FROM child_parent_link) l LEFT JOIN kids k ON l.family = k.family AND l.cnum = k.number
  UNION ALL
  SELECT 'child_parent_link', link_id, 'parent', interviewed_at,
    CASE WHEN l.family IS NULL OR l.pnum IS NULL OR l.pnum <= 0 THEN 'absent' WHEN f.family IS NULL THEN 'missing' ELSE 'none' END
  FROM (SELECT *, {_FAMILY.format('mcsid')} AS family FROM child_parent_link) l LEFT JOIN folk f ON l.family = f.family AND l.pnum = f.number)
"""

P3_FOUND = _CHECKED + "SELECT DISTINCT table_name, record_id, ref_name, cause FROM checked WHERE cause IN ('missing', 'deleted', 'late')"

P3_REPORT = (
    _CHECKED
    + """SELECT table_name, ref_name, coalesce(strftime("at", '%Y'), 'unknown') AS period,
  count(*) FILTER (cause = 'none') AS matched_rows, count(*) FILTER (cause IN ('missing', 'deleted', 'late')) AS unmatched_rows,
  count(*) FILTER (cause = 'missing') AS missing_rows, count(*) FILTER (cause = 'deleted') AS deleted_rows,
  count(*) FILTER (cause = 'late') AS late_rows, count(*) FILTER (cause = 'absent') AS without_reference
FROM checked GROUP BY 1, 2, 3"""
)

_NUMBERS = "adoede00_w1 adoede00_w2 adoede00_w3 adoede00_w5 adroow00_w1 adroow00_w3 apgehe00_w1 apgehe00_w2 apgehe00_w4 apdean00_w1 apsmma00_w2 apaldr00_w1 apaldr00_w5 apwali00_w4 emotion_w2 emotion_w3 emotion_w4 emotion_w6 emotion_w7 non_long__w1__ahcsex00 non_long__w1__apdist9 non_long__w1__adc06e00".split()
_TEXTS = "adacaq00_w3 area_code_w1 interview_month_w2".split()

_PROFILE = (
    "WITH cells AS ("
    + " UNION ALL ".join(f"SELECT load_id, extract_id AS series, load_no AS step, '{c}' AS column_name, true AS is_number, CASE WHEN NOT isnan({c}) THEN {c} END AS dbl, CAST(NULL AS varchar) AS raw FROM wide_features" for c in _NUMBERS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT load_id, extract_id, load_no, '{c}', false, NULL, {c} FROM wide_features" for c in _TEXTS)
    + """),
book AS (SELECT column_name, CASE WHEN NOT isnan(low) THEN low END AS low, CASE WHEN NOT isnan(high) THEN high END AS high, [CAST(x AS double) FOR x IN string_split(sentinel_codes, ',')] AS codes, pattern, partial_missing_threshold FROM feature_codebook),
v AS (SELECT cells.*, book.* EXCLUDE (column_name), trim(raw) AS s, coalesce(dbl, try_cast(trim(raw) AS double)) AS val, try_cast(regexp_extract(raw, '[\\(\\[\\{]\\s*([+-]?[0-9]+(\\.[0-9]*)?)\\s*[\\)\\]\\}]', 1) AS double) AS code FROM cells JOIN book USING (column_name)),
m AS (SELECT *, CASE WHEN is_number THEN val IS NULL ELSE s IS NULL OR s = '' OR lower(s) = 'nan' END OR coalesce(list_contains(codes, val), false) OR coalesce(list_contains(codes, code), false) AS missing FROM v),
valid AS (SELECT *, CASE WHEN is_number OR val IS NULL THEN s ELSE CAST(val AS varchar) END AS txt FROM m WHERE NOT missing),
basic AS (SELECT load_id, series, step, column_name, any_value(is_number) AS is_number, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, any_value(partial_missing_threshold) AS partial_missing_threshold FROM m GROUP BY 1, 2, 3, 4),
seen AS (SELECT load_id, column_name, count(DISTINCT CASE WHEN is_number THEN CAST(val AS varchar) ELSE txt END) AS n_distinct, count(*) FILTER (val < low OR val > high) AS n_out_of_range, count(*) FILTER (NOT regexp_matches(raw, pattern)) AS n_pattern_violations FROM valid GROUP BY 1, 2),
ranked AS (SELECT load_id, column_name, val, row_number() OVER w AS r, count(*) OVER (PARTITION BY load_id, column_name) AS n FROM valid WHERE is_number WINDOW w AS (PARTITION BY load_id, column_name ORDER BY val)),
q AS (SELECT load_id, column_name, min(val) AS min_value, max(val) FILTER (r = ceil(0.25 * n)) AS q25, max(val) FILTER (r = ceil(0.5 * n)) AS median, max(val) FILTER (r = ceil(0.75 * n)) AS q75, max(val) AS max_value FROM ranked GROUP BY 1, 2),
roles AS (SELECT column_name, series, step, val, 1 AS cur, 0 AS prev FROM valid WHERE is_number UNION ALL SELECT column_name, series, step + 1, val, 0, 1 FROM valid WHERE is_number),
points AS (SELECT column_name, series, step, val, sum(cur) AS cur, sum(prev) AS prev FROM roles GROUP BY 1, 2, 3, 4),
curves AS (SELECT *, sum(cur) OVER w AS c, sum(prev) OVER w AS p, sum(cur) OVER g AS cn, sum(prev) OVER g AS pn FROM points WINDOW w AS (PARTITION BY column_name, series, step ORDER BY val), g AS (PARTITION BY column_name, series, step)),
ks AS (SELECT column_name, series, step, max(abs(c / cn - p / pn)) AS ks_distance FROM curves WHERE cn >= 100 AND pn >= 100 GROUP BY 1, 2, 3),
profile AS (
  SELECT b.load_id, b.series, b.step, b.column_name, n_rows, n_missing, n_missing / n_rows AS missing_share, n_rows - n_missing AS n_valid, coalesce(n_distinct, 0) AS n_distinct,
    min_value, q25, median, q75, max_value, coalesce(n_out_of_range, 0) AS n_out_of_range, coalesce(n_pattern_violations, 0) AS n_pattern_violations, ks_distance, partial_missing_threshold
  FROM basic b LEFT JOIN seen USING (load_id, column_name) LEFT JOIN q USING (load_id, column_name) LEFT JOIN ks ON b.column_name = ks.column_name AND b.series = ks.series AND b.step = ks.step)
"""
)

P2_PROFILE = _PROFILE + "SELECT * REPLACE (CAST(step AS bigint) AS step, round(missing_share, 9) AS missing_share, round(ks_distance, 9) AS ks_distance) FROM profile"
P2_FOUND = (
    _PROFILE
    + """SELECT DISTINCT load_id, column_name, unnest(list_filter([
  CASE WHEN n_valid = 0 THEN 'all_effectively_missing' END, CASE WHEN n_distinct = 1 THEN 'single_unique' END,
  CASE WHEN n_valid > 0 AND missing_share > partial_missing_threshold THEN 'partial_missing_over_threshold' END,
  CASE WHEN n_out_of_range > 0 THEN 'out_of_range' END, CASE WHEN n_pattern_violations > 0 THEN 'pattern_violation' END,
  CASE WHEN ks_distance > 0.4001 THEN 'distribution_change' END], lambda x: x IS NOT NULL)) AS finding FROM profile WHERE load_id IS NOT NULL"""
)


P3_PARTIAL = f"""
WITH p AS (SELECT {_FAMILY.format('mcsid')} AS family, CASE WHEN pnum > 0 THEN pnum END AS number FROM parents),
l AS (SELECT link_id, {_FAMILY.format('mcsid')} AS family, CASE WHEN pnum > 0 THEN pnum END AS parent FROM child_parent_link)
SELECT link_id, family IS NULL AS no_family, parent IS NULL AS no_number, CASE
  WHEN family IS NULL AND parent IS NULL THEN 'absent'
  WHEN family IS NULL THEN CASE WHEN parent IN (SELECT number FROM p WHERE number IS NOT NULL) THEN 'none' ELSE 'missing' END
  WHEN parent IS NULL THEN CASE WHEN family IN (SELECT family FROM p WHERE family IS NOT NULL) THEN 'none' ELSE 'missing' END
  WHEN (family, parent) IN (SELECT (family, number) FROM p WHERE family IS NOT NULL AND number IS NOT NULL) THEN 'none' ELSE 'missing' END AS cause
FROM l"""

P1_FIELDS = """
WITH r AS (SELECT file_id, payload FROM raw_records WHERE file_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
k AS (SELECT file_id, payload, unnest(json_keys(payload)) AS field FROM r),
t AS (SELECT file_id, field, json_type(json_extract(payload, '$."' || field || '"')) AS j FROM k),
n AS (SELECT file_id, field, CASE WHEN j IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN j = 'DOUBLE' THEN 'decimal' WHEN j = 'VARCHAR' THEN 'text' WHEN j = 'BOOLEAN' THEN 'true/false' WHEN j = 'ARRAY' THEN 'list' WHEN j = 'OBJECT' THEN 'object' END AS type, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT file_id, field, CAST(coalesce(sum(n) FILTER (type IS NOT NULL), 0) AS bigint) AS n_values, CAST(coalesce(sum(n) FILTER (type IS NULL), 0) AS bigint) AS n_nulls, arg_min(type, (-n, type)) FILTER (type IS NOT NULL) AS type FROM n GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {"p1_fields": P1_FIELDS, "p3_partial": P3_PARTIAL, "p2_found": P2_FOUND, "p2_profile": P2_PROFILE, "p3_found": P3_FOUND, "p3_report": P3_REPORT}
