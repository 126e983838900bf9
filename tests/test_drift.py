import json

import pytest
from pyspark.sql import types as T

from panelforge.operators import drift
from panelforge.operators.matching import assign, best_matching

SCHEMA = "record_id long, file_id long, cohort_id long, dataset string, wave string, file_seq int, subject_key string, payload string, extra string"
MAP = "wave string, canonical string, source string, scope string"


def records(spark, files):
    rows, n = [], 0
    for file_id, cohort, dataset, wave, seq, payloads in files:
        for k, p in enumerate(payloads):
            n += 1
            rows.append((n, file_id, cohort, dataset, wave, seq, f"s{k}", p if p is None or isinstance(p, str) else json.dumps(p), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, files, mapping=()):
    return {tuple(r) for r in drift.schema_changes(records(spark, files), spark.createDataFrame(list(mapping), MAP)).collect()}


def test_changes_of_every_kind(spark):
    a = [{"A": 1, "B": "x", "GONE": 5, "OLD": k, "BEM": k % 3} for k in range(6)]
    b = [{"A": "1", "B": "x", "NEW": str(float(k)), "FRESH": True, " cem": k % 2} for k in range(6)]
    got = found(spark, [(10, 1, "d", "W1", 1, a), (9, 1, "d", "W1", 2, b)], [("W2", "EM", "BEM", "d"), ("W3", "em ", "CEM", None)])
    assert got == {
        (9, "retyped", "A", "A"), (9, "removed", "GONE", ""), (9, "added", "", "FRESH"), (9, "renamed", "OLD", "NEW"),
        (9, "retyped", "OLD", "NEW"), (9, "renamed", "BEM", " cem"),
    }


def test_values_count_only_within_a_wave_and_mapping_only_in_its_dataset(spark):
    a, b = [{"OLD": k} for k in range(6)], [{"NEW": k} for k in range(6)]
    assert found(spark, [(1, 1, "d", "W1", 1, a), (2, 1, "d", "W2", 2, b)], [("W1", "C", "OLD", "other"), ("W1", "C", "NEW", "other")]) == {(2, "removed", "OLD", ""), (2, "added", "", "NEW")}


def test_nulls_bad_payloads_repeats_and_empty(spark):
    a = [{"A": None, "B": 1}, None, "{broken", "[1]", {"B": 1}]
    b = [{"A": 3, "B": 1}, {"A": 3, "B": 1}]
    assert found(spark, [(1, 1, "d", "W1", 1, a), (2, 1, "d", "W1", 2, b), (3, 2, "d", "W1", 1, b)]) == set()
    assert found(spark, []) == set()
    # a file whose payloads cannot be read still has its place in the series
    assert found(spark, [(1, 1, "d", "W1", 1, [None, "{"]), (2, 1, "d", "W1", 2, b)]) == {(2, "added", "", "A"), (2, "added", "", "B")}


def test_file_order_is_file_seq_and_ties_go_by_id(spark):
    a, b = [{"A": 1}], [{"B": "x"}]
    assert found(spark, [(5, 1, "d", "W1", 1, a), (4, 1, "d", "W1", 1, b)]) == {(5, "removed", "B", ""), (5, "added", "", "A")}


def test_types(spark):
    values = [{"i": 1, "d": 1.0, "e": 1e3, "t": "1", "b": True, "l": [1], "o": {"x": 1}, "n": None, "big": 12345678901234567890}]
    fields = drift.read_fields(records(spark, [(1, 1, "d", "W1", 1, values)]))
    assert {r["field"]: r["type"] for r in fields.collect()} == {"i": "integer", "d": "decimal", "e": "decimal", "t": "text", "b": "true/false", "l": "list", "o": "object", "n": None, "big": "integer"}


@pytest.mark.parametrize("values", [(7, "7", 7.0, [7], {"code": 7, "label": "x"}, "7. good"), (True, "Y", "yes"), ("2020-01-02", 20200102)])
def test_equal_values_however_typed(spark, values):
    fields = drift.read_fields(records(spark, [(1, 1, "d", "W1", 1, [{"a": v} for v in values])]))
    assert len({r["canon"] for r in fields.collect()}) == 1


def test_unified_table_keeps_every_record(spark):
    a = [{"AEM": k, "Z": "u"} for k in range(4)]
    b = [{"BEM": [k], "Y": "u"} for k in range(4)]
    mapping = spark.createDataFrame([("W1", "EM", "AEM", None), ("W2", "EM", "BEM", None)], MAP)
    r = records(spark, [(1, 1, "d", "W1", 1, a), (2, 1, "d", "W1", 2, [*b, None])])
    out = drift.unify_records(r, mapping, drift.schema_changes(r, mapping)).collect()
    assert len(out) == 9
    assert sorted(str(x["em"]) for x in out) == sorted(["0", "1", "2", "3"] * 2 + ["None"])
    assert {x["other_fields"] for x in out} == {"Z=u", ""}  # Y is Z under its first name


def test_assignment_is_optimal(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (2, 3), (4, 4), (3, 6)):
        cost = rng.normal(size=(n, m))
        got = cost[range(n), assign(cost)].sum()
        assert got == pytest.approx(min(cost[range(n), list(p)].sum() for p in itertools.permutations(range(m), n)))


def test_matching_prefers_total_weight(spark):
    edges = [(1, "a", "x", 5.0), (1, "a", "y", 4.0), (1, "b", "x", 4.0), (2, "a", "x", 1.0)]
    got = best_matching(spark.createDataFrame(edges, "file_id long, old_field string, new_field string, weight double"), "file_id")
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(1, "a", "y"), (1, "b", "x"), (2, "a", "x")}


def test_schema_is_stable(spark):
    got = drift.schema_changes(records(spark, []), spark.createDataFrame([], MAP)).schema
    assert [(f.name, f.dataType) for f in got] == [("file_id", T.LongType()), ("change_kind", T.StringType()), ("old_field", T.StringType()), ("new_field", T.StringType())]
