import random

import pytest

from panelforge.core.errors import InputValidationError
from panelforge.operators import quality

BOOK = "column_name string, kind string, low double, high double, sentinel_codes string, pattern string, partial_missing_threshold double"
WIDE = "load_id long, extract_id long, load_no int, a double, t string, b double, step string"


def book(spark):
    return spark.createDataFrame([("a", "continuous", 0.0, 10.0, "-9,-1", None, 0.5), ("T", "text", float("nan"), None, "-9,96", "^([1-5]|95)(\\.0)?$", 0.5), ("nope", "text", None, None, None, None, 0.5)], BOOK)


def profile(spark, rows, **options):
    return quality.quality_profile(spark.createDataFrame(rows, WIDE), book(spark), load="load_id", series="extract_id", step="load_no", **options)


def by_column(df):
    return {(r["load_id"], r["column_name"]): r for r in df.collect()}


def test_missing_values_however_written(spark):
    texts = ["1", " 2.0 ", "-9", "-9.0", " -9 ", "Refused (-9)", "None of these [96]", "Label (5)", "", "  ", "nan", None, "three"]
    rows = [(11, 1, 1, float("nan") if k % 2 else -9.0, t, 1.0, "x") for k, t in enumerate(texts)]
    got = by_column(profile(spark, rows))
    t = got[11, "t"]
    assert (t["n_rows"], t["n_valid"], t["n_distinct"], t["n_pattern_violations"]) == (13, 4, 4, 3)  # ' 2.0 ', the label and three
    assert (got[11, "a"]["n_valid"], got[11, "a"]["median"]) == (0, None)
    found = {tuple(r) for r in quality.findings(profile(spark, rows)).collect()}
    assert found == {(11, "a", "all_effectively_missing"), (11, "t", "partial_missing_over_threshold"), (11, "t", "pattern_violation")}


def test_findings_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for load in range(4):
        for _ in range(130):
            value = rng.choice([-9.0, None, float("nan"), rng.gauss(3 + 2 * (load == 2), 1), 12.0 if load == 3 else 5.0])
            rows.append((10 + load, 1, load, value, "1", 0.0, "x"))
    valid = {k: sorted(r[3] for r in rows if r[0] == k and r[3] is not None and r[3] == r[3] and r[3] != -9.0) for k in range(10, 14)}
    got = by_column(profile(spark, rows, min_valid=20))
    for k, v in valid.items():
        r = got[k, "a"]
        assert (r["n_valid"], r["n_distinct"], r["min_value"], r["max_value"]) == (len(v), len(set(v)), v[0], v[-1])
        for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            assert r[name] == v[-(-len(v) * int(q * 100) // 100) - 1]
        if k > 10:
            p = valid[k - 1]
            points = sorted(set(v) | set(p))
            want = max(abs(sum(x <= c for x in v) / len(v) - sum(x <= c for x in p) / len(p)) for c in points)
            assert r["ks_distance"] == pytest.approx(want)
    assert got[10, "a"]["ks_distance"] is None
    assert by_column(profile(spark, rows, min_valid=1000))[12, "a"]["ks_distance"] is None


def test_single_value_empty_table_and_errors(spark):
    rows = [(1, 1, 1, 4.0, "3", 0.0, "x"), (1, 1, 1, 4.0, "3.0", 0.0, "x"), (None, None, None, 11.0, None, 0.0, None)]
    got = by_column(profile(spark, rows))
    assert got[1, "a"]["n_distinct"] == got[1, "t"]["n_distinct"] == 1
    assert got[None, "a"]["n_out_of_range"] == 1
    assert {tuple(r) for r in quality.findings(profile(spark, rows)).collect()} == {(1, "a", "single_unique"), (1, "t", "single_unique")}
    assert profile(spark, []).count() == 0
    with pytest.raises(InputValidationError):
        quality.quality_profile(spark.createDataFrame(rows, WIDE), book(spark), load="nope", series="extract_id", step="load_no")


def test_curves_do_not_depend_on_partitioning(spark):
    rows = [(1, 1, 1, float(k % 17), "1", 0.0, "x") for k in range(300)] + [(2, 1, 2, float(k % 23), "1", 0.0, "x") for k in range(300)]
    seen = set()
    for n in (1, 2, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        r = by_column(profile(spark, rows))[2, "a"]
        seen.add((r["ks_distance"], r["median"], r["n_distinct"]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
