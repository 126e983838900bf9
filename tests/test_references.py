from datetime import datetime

import pytest

from panelforge.core.errors import InputValidationError
from panelforge.operators.references import check_references, orphans, reference_report

T = [datetime(2020, 1, d) for d in range(1, 10)]


def refs(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b long, at timestamp, since timestamp")


def keys(spark, rows):
    return spark.createDataFrame(rows, "a string, b long, since timestamp, until timestamp, id long")


def causes(df):
    return {r["id"]: r["cause"] for r in df.collect()}


def test_match_semantics_by_null_mask(spark):
    r = refs(spark, [(1, "x", 1, T[3], None), (2, "x", 2, T[3], None), (3, "x", None, T[3], None), (4, "y", None, T[3], None), (5, None, None, T[3], None), (6, None, 1, T[3], None)])
    k = keys(spark, [("x", 1, None, None, 7), ("x", 1, None, None, 8), (None, 2, None, None, 9)])
    assert causes(check_references(r, ["a", "b"], k, ["a", "b"])) == {1: "none", 2: "missing", 3: "absent", 4: "absent", 5: "absent", 6: "absent"}
    assert causes(check_references(r, ["a", "b"], k, ["a", "b"], match="full")) == {1: "none", 2: "missing", 3: "missing", 4: "missing", 5: "absent", 6: "missing"}
    assert causes(check_references(r, ["a", "b"], k, ["a", "b"], match="partial")) == {1: "none", 2: "missing", 3: "none", 4: "missing", 5: "absent", 6: "none"}


def test_deleted_and_late_with_ties_and_null_times(spark):
    k = keys(spark, [("x", 1, T[2], T[5], 0), ("y", 1, T[2], T[4], 0), ("y", 1, T[1], None, 0), ("z", 1, None, None, 0)])
    rows = [(1, "x", 1, T[1]), (2, "x", 1, T[2]), (3, "x", 1, T[4]), (4, "x", 1, T[5]), (5, "x", 1, None), (6, "y", 1, T[8]), (7, "y", 1, T[0]), (8, "z", 1, T[0])]
    got = causes(check_references(refs(spark, [(*r, None) for r in rows]), ["a", "b"], k, ["a", "b"], at="at", since="since", until="until"))
    assert got == {1: "late", 2: "none", 3: "none", 4: "deleted", 5: "none", 6: "none", 7: "late", 8: "none"}


def test_rows_never_multiply_and_hot_keys_stay_whole(spark):
    r = refs(spark, [(k, "hot", 1, T[0], None) for k in range(500)] + [(1000, "z", 1, T[0], None)] * 3)
    k = keys(spark, [("hot", 1, None, None, 1)] * 20)
    assert check_references(r, ["a", "b"], k, ["a", "b"]).count() == 503
    assert orphans(r, ["a", "b"], k, ["a", "b"]).count() == 3


def test_empty_tables_and_report(spark):
    r, none = refs(spark, [(1, "x", 1, T[0], None), (2, None, 1, T[0], None)]), keys(spark, [])
    checked = check_references(r, ["a", "b"], none, ["a", "b"])
    assert causes(checked) == {1: "missing", 2: "absent"}
    assert check_references(refs(spark, []), ["a", "b"], none, ["a", "b"]).count() == 0
    report = reference_report(checked, ["at"]).collect()
    assert [(x["matched_rows"], x["unmatched_rows"], x["without_reference"]) for x in report] == [(0, 1, 1)]


def test_bad_parameters(spark):
    r, k = refs(spark, []), keys(spark, [])
    for kw in ({"match": "odd"}, {"cause": "a"}):
        with pytest.raises(InputValidationError):
            check_references(r, ["a"], k, ["a"], **kw)
    with pytest.raises(InputValidationError):
        check_references(r, ["a", "b"], k, ["a"])
