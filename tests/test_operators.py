import math

import pytest
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.operators import aggregate, clean, encode, impute, joins, project, reshape, sentinels

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- projections
def test_remove_and_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, `c d` long")
    assert project.remove_columns(df, ["b"]).columns == ["a", "c d"]
    assert project.rename_feature(df, "c d", "x").columns == ["a", "b", "x"]
    for bad in (["b", "b"], ["nope"], ["a", "b", "c d"]):
        with pytest.raises(InputValidationError):
            project.remove_columns(df, bad)
    with pytest.raises(InputValidationError, match="close names: c d"):
        project.rename_feature(df, "cd", "x")
    with pytest.raises(InputValidationError):
        project.rename_feature(df, "a", "b")


def test_feature_resolution_prefers_exact_then_scope_then_fullest(spark):
    df = spark.createDataFrame([(1, None, 3, 4), (1, None, 3, None)], "EXACT long, one__Q long, two__Q long, one__R long")
    got = project.resolve_features(df, {"e": ("exact", None), "q": ("Q", None), "s": ("Q", "one"), "r": ("R", None), "n": ("Z", None)})
    assert got == {"e": "EXACT", "q": "two__Q", "s": "one__Q", "r": "one__R", "n": None}


def test_targets(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "t string")
    coded, codes = project.label_codes(df, "t")
    assert codes == {"a": 0, "b": 1} and sorted(str(r["t_code"]) for r in coded.collect()) == ["0", "0", "1", "None"]
    assert project.scenario_names(["A b", "a-b", "c"]) == {"A b": "traj_a_b_vs_rest", "a-b": "traj_a_b_vs_rest_1", "c": "traj_c_vs_rest"}
    assert project.one_vs_rest(df, "t").columns == ["t", "traj_a_vs_rest", "traj_b_vs_rest"]


# ---- encodings
def test_row_reducers(spark):
    df = spark.createDataFrame([(1.0, NAN, "4"), (None, None, "x"), (3.0, 1.0, None)], "a double, b double, c string")
    want = {"sum": [5.0, None, 4.0], "mean": [2.5, None, 2.0], "median": [2.5, None, 2.0], "min": [1.0, None, 1.0], "max": [4.0, None, 3.0]}
    for how, values in want.items():
        assert [r[0] for r in df.select(encode.reduce_row(df, ["a", "b", "c"], how)).collect()] == values
    assert [r[0] for r in df.select(encode.reduce_row(df, ["b", "a"], "coalesce")).collect()] == [1.0, None, 1.0]
    with pytest.raises(InputValidationError):
        encode.reduce_row(df, ["a"], "odd")


def test_encodings(spark):
    df = spark.createDataFrame([("1", 2.0), ("2.0", 9.0), ("x", None), (None, NAN)], "a_w1 string, b double")
    assert [r[0] for r in df.select(encode.binary(df, "a_w1", {1: 0, 2: 1})).collect()] == [0.0, 1.0, None, None]
    assert [r[0] for r in df.select(encode.ordinal(df, "b", [9, 2])).collect()] == [2.0, 1.0, None, None]
    out = encode.one_hot(df, {"a_w1": [1, 2.5]})
    assert out.columns == ["b", "a__v1_w1", "a__v2p5_w1"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1.0, 0.0), (0.0, 0.0), (None, None), (None, None)]
    clash = df.withColumn("a__v1_w1", F.lit(1))
    with pytest.raises(InputValidationError):
        encode.one_hot(clash, {"a_w1": [1]})


def test_column_names_are_the_schema():
    r = encode.column_role
    assert (r("emotion_w7").root, r("emotion_w7").wave, r("emotion_w7").static) == ("emotion", 7, False)
    assert (r("non_long__w1__sex").root, r("non_long__w1__sex").static) == ("sex", True)
    assert r("chid").wave is None
    made = ["q__v1_w1", "q__v2_w1", "z__v1_w1", "z__v1_w2"]
    assert encode.single_wave_names(made, ["q__v1_w1", "z__v1_w1", "z__v1_w2"]) == {"q__v1_w1": "non_long__w1__q__v1"}
    with pytest.raises(InputValidationError, match="zz"):
        encode.require_policy(["a_w1", "zz_w2"], ["A"])


# ---- sentinels
def test_sentinels_however_written(spark):
    df = spark.createDataFrame([("-9.0", 5.0), (" 96", NAN), ("1", -1.0), ("Refused (-8)", None), (None, 3.0)], "a string, b double")
    assert [r["b"] for r in sentinels.target_rows(df, "b").collect()] == [5.0, 3.0]
    out = sentinels.replace_sentinels(df, {"a": [-9, 96], "b": [-1]})
    assert [r["a"] for r in out.collect()] == [None, None, "1", "Refused (-8)", None]
    assert {tuple(r) for r in sentinels.observed_codes(df, ["a", "b"]).collect()} == {("a", -9, 1), ("a", 96, 1), ("b", -1, 1)}
    assert {tuple(r) for r in sentinels.label_codes(df, ["a", "b"]).collect()} == {("a", -8)}
    assert {tuple(r) for r in sentinels.replacement_counts(df, {"a": [-9, 96], "b": [-1]}).collect()} == {("a", 2), ("b", 1)}
    s = sentinels.target_row_summary(df, "b").first()
    assert (s["rows_before"], s["rows_after"], s["null_targets"], s["sentinel_targets"]) == (5, 2, 2, 1)


def test_choice_of_codes():
    got = sentinels.choose_codes(["a_w1", "b_w1", "c_w2", "d"], {"A": [-2]}, {"b_w1": {-8}}, {"b_w1": {-1}, "c_w2": {-9}})
    assert got == {"a_w1": ("root_override", [-2]), "b_w1": ("label_terms", [-8]), "c_w2": ("observed_fallback", [-9]), "d": ("none", [])}
    assert sentinels.compact_map(got) == [("a", [1], [-2]), ("b", [1], [-8]), ("c", [2], [-9])]


# ---- aggregation
def test_cross_section(spark):
    df = spark.createDataFrame([(1, 1, 2.0, "b"), (1, 2, NAN, "a"), (1, 3, 4.0, None), (2, 1, None, None), (None, 1, 7.0, "z")], "id long, o long, v double, c string")
    agg = lambda **k: {r["id"]: r for r in aggregate.aggregate_to_cross_section(df, "id", numeric_cols=["v"], categorical_cols=["c"], **k).collect()}
    out = agg()
    assert (out[1]["v"], out[1]["c"], out[2]["v"], out[2]["c"], out[None]["v"]) == (3.0, "a", None, None, 7.0)
    assert agg(numeric_agg="std")[1]["v"] == pytest.approx(math.sqrt(2)) and agg(numeric_agg="std")[None]["v"] is None
    assert (agg(categorical_agg="first", order="o")[1]["c"], agg(categorical_agg="last", order="o")[1]["c"]) == ("b", "a")
    with pytest.raises(InputValidationError):
        agg(categorical_agg="first")
    assert aggregate.aggregate_to_cross_section(df.limit(0), "id", numeric_cols=["v"]).count() == 0


def test_hot_subjects_are_aggregated_from_counts(spark):
    import random

    rng = random.Random(0)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.random(), None, NAN]), rng.choice("abc"), 1.0) for _ in range(300)]
    df = spark.createDataFrame(data, "id long, v double, c string, w double")
    runs = [{r["id"]: tuple(r) for r in aggregate.aggregate_to_cross_section(df, "id", numeric_cols=["v", "w"], categorical_cols=["c"], numeric_agg="median", hot_rows=h).collect()} for h in (10**6, 100, 0)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3
    series = {r["subject_id"]: r for r in reshape.long_to_series(spark.createDataFrame([(1, 2, 4.0), (1, 1, 3.0), (1, 2, 6.0), (1, None, 1.0)], "s long, t long, v double"), "s", "t", ["v"]).collect()}
    assert (series[1]["times"], series[1]["series"]) == ([1.0, 2.0], [[3.0], [5.0]])


def test_group_checks(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", "x"), (2, "b", "y"), (2, "c", "y"), (3, None, None), (3, None, None)], "id long, p string, q string")
    assert {tuple(r) for r in aggregate.varying_columns(df, ["id"], ["p", "q"]).collect()} == {("p", 1), ("q", 1)}
    assert tuple(aggregate.duplicate_rows(df, ["id", "p"]).first()) == (4, 2)
    assert {tuple(r) for r in aggregate.complete_subjects(df, "id", ["p", "q"]).collect()} == {(1, False), (2, True), (3, False)}
    assert tuple(aggregate.missing_cells(df).first()) == (5, 6)


def test_lines(spark):
    df = spark.createDataFrame([("a", 1, 3.0, 1.0), ("a", 2, 5.0, 1.0), ("a", 3, 7.0, 5.0), ("b", 1, 4.0, 1.0)], "g string, t long, y double, w double")
    out = {r["class"]: r for r in aggregate.weighted_lines(df, "g", "t", "y", "w").collect()}
    assert (out["a"]["intercept"], out["a"]["slope"]) == (pytest.approx(1.0), pytest.approx(2.0)) and out["b"]["slope"] is None


# ---- reshape
def test_pivot_names_and_errors(spark):
    df = spark.createDataFrame([(1, 1.5, 2.0, "f"), (1, 2.0, 3.0, "f"), (2, 2.0, None, "m")], "id long, t double, v double, s string")
    out = reshape.pivot_long_to_wide(df, ["id"], "t", static=["s"], time_label="w")
    assert out.columns == ["id", "s", "v_w1p5", "v_w2"] and rows(out, "id") == [(1, "f", 2.0, 3.0), (2, "m", None, None)]
    assert reshape.time_token(None) == "missing" and reshape.time_token("a  b") == "a_b"
    again = df.union(df.limit(1))
    with pytest.raises(InputValidationError, match="2 rows share"):
        reshape.pivot_long_to_wide(again, ["id"], "t")
    with pytest.raises(InputValidationError, match="vary"):
        reshape.pivot_long_to_wide(df.withColumn("s", F.col("t").cast("string")), ["id"], "t", static=["s"])
    with pytest.raises(InputValidationError):
        reshape.pivot_long_to_wide(df.withColumn("t", F.lit(None).cast("double")), ["id"], "t")
    with pytest.raises(InputValidationError):
        reshape.pivot_long_to_wide(df, ["id"], "t", separator=".")


@pytest.mark.parametrize("seed", range(3))
def test_unpivot_undoes_pivot(spark, seed):
    import random

    rng = random.Random(seed)
    long = {(i, t): (rng.choice([None, 1.0, 2.5]), rng.random()) for i in range(6) for t in (1, 2, 4) if rng.random() < 0.8}
    df = spark.createDataFrame([(i, t, *v) for (i, t), v in long.items()], "id long, wave long, a double, b double")
    wide = reshape.pivot_long_to_wide(df, ["id"], "wave", time_label="w")
    groups = reshape.feature_groups(wide.columns, "_w")
    assert set(groups) == {"a", "b"}
    back = reshape.unpivot_wide(wide, ["id"], groups)
    assert {(r["id"], r["wave"]): (r["a"], r["b"]) for r in back.collect()} == long


def test_slots_unions_and_first(spark):
    df = spark.createDataFrame([("A", 1, 5, None, 1), ("A", 1, 6, "y", 2), ("A", 0, 7, "z", 3), ("B", 2, 8, "w", 4)], "f string, p long, v long, s string, o long")
    out = reshape.pivot_slots(df, ["f"], project.slot_label(F.col("p")), ["p1", "p2"], ["v", "s"], ["o"])
    assert rows(out, "f") == [("A", 5, "y", None, None), ("B", None, None, 8, "w")]
    both = reshape.union_by_name([df.select("f", "p"), df.select("f", "s")])
    assert both.columns == ["f", "p", "s"] and both.count() == 8
    assert rows(reshape.keep_first(df, ["f"], ["o"]).select("f", "v"), "f") == [("A", 5), ("B", 8)]
    assert reshape.union_keys([df, df], ["f", "p"]).count() == 3


def test_waves_to_wide_and_order(spark):
    df = spark.createDataFrame([("c", "W10", 1.0, None), ("c", "W2", 2.0, "x"), ("c", "W1", None, "y")], "id string, wave string, v double, s string")
    assert rows(reshape.waves_to_wide(df, "id", "wave", ["W1", "W2", "W10"], ["v"], ["s"])) == [("c", "y", None, 2.0, 1.0)]
    assert [r["wave"] for r in reshape.sort_long(df, "id", "wave").collect()] == ["W1", "W2", "W10"]


# ---- joins
def test_combination(spark):
    data = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    traj = spark.createDataFrame([("1", 0, "low"), (" 1 ", 1, "high"), (None, 5, "x")], "sid string, cls long, name string")
    out = joins.combine_with_trajectories(data, traj, "id", "sid", order=["cls"])
    assert out.columns == ["id", "name", "cls", "name_trajectory"]
    one = joins.combine_with_trajectories(data, traj.filter("cls <> 1"), "id", "sid", how="inner", drop=["name"])
    assert rows(one) == [(1, 0, "low")]
    assert tuple(joins.unmatched_rows(out.filter("name <> 'a'"), ["cls", "name_trajectory"]).first()) == (2, 2)
    with pytest.raises(InputValidationError):
        joins.combine_with_trajectories(data, traj, "id", "sid", how="outer")


def test_role_joins_never_multiply(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "f string, n long")
    b = spark.createDataFrame([("x", 5), (None, 6)], "f string, v long")
    assert rows(joins.join_roles(a, [(b, ["f"], "b")]), "f", "n") == [("x", 1, 5), ("x", 2, 5), ("y", 1, None)]
    with pytest.raises(InputValidationError, match="repeated keys"):
        joins.join_roles(a, [(b.union(b), ["f"], "b")])
    with pytest.raises(InputValidationError, match="exist already"):
        joins.join_roles(a, [(b.withColumn("n", F.lit(1)), ["f"], "b")])
    assert tuple(joins.coverage(a, b, ["f"]).first()) == (2, 1)


# ---- imputation
def test_simple_imputers(spark):
    df = spark.createDataFrame([(1, 2.0, "a", None), (2, NAN, "b", None), (None, 4.0, None, None), (4, 6.0, "b", None)], "i long, v double, s string, e double")
    assert [r["v"] for r in impute.impute(df, "mean_imputation").collect()] == [2.0, 4.0, 4.0, 6.0]
    assert [r["i"] for r in impute.impute(df, "median_imputation").collect()] == [1.0, 2.0, 2.0, 4.0]
    mode = impute.impute(df, "most_frequent_imputation").collect()
    assert ([r["s"] for r in mode], [r["i"] for r in mode], [r["e"] for r in mode]) == (["a", "b", "b", "b"], [1, 2, 1, 4], [None] * 4)
    const = impute.impute(df, "constant_imputation").collect()
    assert ([r["s"] for r in const], [r["i"] for r in const], [r["e"] for r in const]) == (["a", "b", "missing", "b"], [1, 2, 0, 4], [0.0] * 4)
    assert dict(impute.impute(df, "constant_imputation", fill_value="?").dtypes)["i"] == "string"
    assert impute.imputation_report(df, impute.impute(df, "mean_imputation")).first()["missing_before"] == 7
    with pytest.raises(InputValidationError):
        impute.impute(df.select("s"), "mean_imputation")
    with pytest.raises(InputValidationError):
        impute.impute(df, "mean_imputation", iterations=3)
    assert impute.impute(df.limit(0), "mean_imputation").count() == 0


def test_chained_equations_keep_values_and_follow_the_relation(spark):
    import random

    rng = random.Random(0)
    data = [(float(k), 2.0 * k + rng.gauss(0, 0.5) if k % 5 else None, None if k == 7 else "t") for k in range(100)]
    df = spark.createDataFrame(data, "x double, y double, s string")
    out = {r["x"]: r for r in impute.impute(df, "mice_imputation", iterations=2).collect()}
    assert all(out[x]["y"] == y for x, y, _ in data if y is not None) and out[7.0]["s"] == "t"
    assert max(abs(out[x]["y"] - 2 * x) for x, y, _ in data if y is None) < 15
    again = {r["x"]: r["y"] for r in impute.impute(df, "mice_imputation", iterations=2).collect()}
    assert again == {x: r["y"] for x, r in out.items()}


# ---- cleaning
def test_type_cleaning(spark):
    df = spark.createDataFrame([("1", "NA", "2020-01-02", "c", "u1"), ("2.5", " ", "2021-03-04", "c", "u2")], "n string, e string, d string, c string, u string")
    out = clean.clean_types(df, drop_if_constant=True, drop_if_unique=True)
    assert dict(out.dtypes) == {"n": "double", "d": "timestamp"}
    assert clean.clean_types(df, drop_null_fraction=None).columns == df.columns
    assert clean.clean_types(df.limit(0)).columns == df.columns
    assert dict(clean.clean_types(df, numeric_to_float32=True).dtypes)["n"] == "float"


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "-9"), (NAN, "x"), (None, None), (1.0, "x")], "a double, b string")
    got = {r["column_name"]: r for r in clean.profile_columns(df, codes=[-9]).collect()}
    assert (got["a"]["na_count"], got["a"]["valid_count"], got["a"]["nunique_valid"], got["a"]["dtype"]) == (2, 2, 1, "double")
    assert (got["b"]["na_count"], got["b"]["effective_missing_count"], got["b"]["nunique_valid"]) == (1, 2, 1)


def test_label_clusters(spark):
    counts = {"North": 9, "north": 3, "NORTH ": 1, "Nrth": 2, "South": 5, "Sth": 1}
    got = clean.cluster_labels(counts, 2)
    assert {got["north"], got["NORTH "], got["Nrth"]} == {"North"} and got["Sth"] == "South"
    df = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)] + [(None,)], "s string")
    out, mapping = clean.harmonise_categories(df, ["s"], 2)
    assert {r["s"] for r in out.collect()} == {"North", "South", None} and mapping.count() == 6
    with pytest.raises(InputValidationError):
        clean.harmonise_categories(df, ["s"], 1)


def test_spearman_with_ties_and_gaps(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = pd.DataFrame({"a": rng.integers(0, 5, 60).astype(float), "b": rng.normal(size=60), "c": 1.0})
    x["d"] = x["a"] * 2 + rng.integers(0, 2, 60)
    x.loc[rng.integers(0, 60, 10), "a"] = np.nan
    got = {(r["feature_a"], r["feature_b"]): r["rho"] for r in clean.spearman_pairs(spark.createDataFrame(x), list("abcd")).collect()}
    assert set(got) == {("a", "b"), ("a", "d"), ("b", "d")}
    for (i, j), rho in got.items():
        own = x[[i, j]].dropna().rank()
        assert rho == pytest.approx(own[i].corr(own[j]))


def test_pruning_order():
    pairs = [("a", "b", 0.99), ("b", "c", 1.0), ("a", "d", 0.98)]
    assert clean.prune_correlated(pairs, {"b": 0.1, "c": 0.3}) == [("c", "b", "more_missing", 1.0), ("b", "a", "more_missing", 0.99), ("d", "a", "tie", 0.98)]
