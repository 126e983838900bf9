import io
import json

import pytest
from pyspark.sql import functions as F

from panelforge.bridge import catalog, runner
from panelforge.core.errors import InputValidationError, OperationNotFoundError
from panelforge.plans import prepare as P
from panelforge.plans import preprocess as PP
from panelforge.streaming import incremental


def tables(spark, wave):
    child = spark.createDataFrame([("F1", 1, 10.0), ("F1", 2, 11.0), (" f2 ", 1, 12.0), ("F3", -1, 9.0), (None, 1, 1.0)], "mcsid string, ACNUM00 long, EM double")
    family = spark.createDataFrame([("F1", 100.0), ("F2", 200.0), ("F9", 900.0)], "MCSID string, INC double")
    parent = spark.createDataFrame([("F1", 1, 5.0), ("F1", 2, 6.0), ("F2", 1, 7.0)], "MCSID string, PN long, H double")
    link = spark.createDataFrame([("F1", 1, 1, 0.5), ("F1", 1, 2, 0.6), ("F2", 1, 1, 0.7), ("F4", 1, 0, 0.8), ("F5", 1, 1, 0.9)], "MCSID string, CN long, PN long, A double")
    source = [P.SourceTable("child", "cm", child, "ACNUM00"), P.SourceTable("family", "fam", family), P.SourceTable("parent", "par", parent, None, "PN"), P.SourceTable("link", "lnk", link, "CN", "PN")]
    return P.WaveInput(wave, source, {"EM": ("EM", "cm"), "INC": ("INC", None), "H": ("p1__par__H", None), "SUM": ("SUM", None), "NO": ("NO", None)}, {"A": ("p1__lnk__A", None)})


def test_preparation(spark):
    w1, w2 = tables(spark, "W1"), tables(spark, "W2")
    w2.longitudinal = {"EM": ("EM", "cm")}
    done = P.prepare([w2, w1], [P.Composite("SUM", ("p1__par__H", "p2__par__H"), "sum", ("W1",))])
    long = {(r["CHID"], r["wave"]): r for r in done.long.collect()}
    assert set(long) == {(c, w) for c in ("F1_1", "F1_2", "F2_1", "F5_1") for w in ("W1", "W2")}
    one = long["F1_1", "W1"]
    assert (one["EM"], one["INC"], one["H"], one["SUM"], one["non_long__w1__A"]) == (10.0, 100.0, 5.0, 11.0, 0.5)
    assert (long["F1_2", "W1"]["H"], long["F5_1", "W1"]["EM"]) == (None, None)
    assert done.unresolved == {"W1": ["NO"]}
    wide = {r["CHID"]: r for r in done.wide.collect()}
    assert (wide["F2_1"]["EM_w1"], wide["F2_1"]["EM_w2"], wide["F2_1"]["INC_w1"], wide["F2_1"]["INC_w2"]) == (12.0, 12.0, 200.0, None)
    assert {r["alias"]: (r["anchor_rows"], r["matched_rows"]) for r in done.coverage} == {"cm": (4, 3)}
    assert P.preview([w1])["roles"]["W1"] == {"family": 1, "child": 1, "parent": 1, "link": 1}


def test_preparation_errors(spark):
    w = tables(spark, "W1")
    w.tables[1].data = w.tables[1].data.union(w.tables[1].data)
    with pytest.raises(InputValidationError, match="fam has repeated keys"):
        P.prepare([w])
    bad = tables(spark, "W1")
    bad.tables[0].cnum_source = "ZZ"
    with pytest.raises(InputValidationError, match="no column"):
        P.prepare([bad])
    with pytest.raises(InputValidationError):
        P.prepare([], output="long")


def wide(spark):
    rows = []
    for k in range(20):
        rows.append((f"c{k}", f"m{k}", [3.0, None, -1.0][k % 3 if k < 3 else 0], float(k), [1.0, 2.0, -9.0][k % 3], [1.0, 2.0, 95.0][k % 3], [1.0, 2.0][k % 2], -9.0, 7.0, None if k < 14 else float(k), ["1", "Refused (-8)", "2"][k % 3], float(k) * 2 + 1, 4.0 if k % 2 else 5.0, None))
    return spark.createDataFrame(rows, "chid string, mcsid string, target_w7 double, target_w6 double, bin_w1 double, rank_w2 double, nom_w1 double, gone_w1 double, const_w1 double, thin_w1 double, lab_w1 string, twin_w1 double, leak_w1 double, base_w2 double")


def policy(**k):
    enc = {"bin": PP.RootPolicy("binary", mapping={1: 0, 2: 1}), "rank": PP.RootPolicy("ordinal", ordered=[1, 2, 95]), "nom": PP.RootPolicy("nominal", codes=[1, 2, 3]), "lab": PP.RootPolicy("continuous"), "twin": PP.RootPolicy("continuous")}
    return PP.Policy(target="target_w7", keep_ids=["chid"], drop_ids=["mcsid"], target_history=["target_w6"], leakage=["leak_w1"], baseline_roots=["base"], encodings=enc, **k)


def test_preprocessing(spark):
    done = PP.preprocess(wide(spark), policy())
    a = done.audits
    assert a["stage0_target_row_policy"][0]["rows_after"] == 18 and done.data.count() == 18
    assert {r["column_name"]: r["reason"] for r in a["stage1_obvious_remove_features"]} == {
        "base_w2": "baseline_only_over_time", "mcsid": "secondary_identifier", "target_w6": "target_history", "gone_w1": "all_effectively_missing", "const_w1": "single_unique_valid", "thin_w1": "partial_missing_over_threshold",
    }
    status = {r["column_name"]: (r["status"], r["codes"]) for r in a["stage2_column_sentinel_validation"]}
    assert status["bin_w1"] == ("observed_fallback", [-9]) and status["lab_w1"] == ("label_terms", [-8])
    assert a["stage3_leakage_dropped_features"] == [{"column_name": "leak_w1"}]
    assert {r["column_name"] for r in a["stage5_nominal_one_hot_created_columns"]} == {"nom__v1_w1", "nom__v2_w1", "nom__v3_w1"}
    assert a["stage5_constant_predictor_dropped_features"] == [{"column_name": "nom__v3_w1"}]
    assert set(done.data.columns) == {"chid", "target_w7", "bin_w1", "rank_w2", "lab_w1", "twin_w1", "non_long__w1__nom__v1", "non_long__w1__nom__v2"}
    assert len(a) == 33
    assert {r["rank_w2"] for r in done.data.collect()} <= {1.0, 2.0, 3.0, None}


def test_preprocessing_needs_a_policy_for_each_root(spark):
    p = policy()
    p.encodings = {k: v for k, v in p.encodings.items() if k != "twin"}
    with pytest.raises(InputValidationError, match="twin"):
        PP.preprocess(wide(spark), p)


def test_audit_files(spark, tmp_path):
    files = PP.write_audits(PP.preprocess(wide(spark), policy()), str(tmp_path))
    assert len(files) == 34 and "rows_after" in (tmp_path / "stage0_target_row_policy.csv").read_text()


# ---- bridge
def call(monkeypatch, capsys, text):
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    code = runner.main([])
    return code, json.loads(capsys.readouterr().out)


def test_bridge_codes(monkeypatch, capsys):
    assert runner.main(["--ping"]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert call(monkeypatch, capsys, "{")[0] == 2
    assert call(monkeypatch, capsys, '{"operation": "nope"}')[0] == 3
    assert call(monkeypatch, capsys, '{"operation": "rename_feature.run", "params": {"x": 1}}')[0] == 1
    code, said = call(monkeypatch, capsys, '{"operation": "core.catalog"}')
    assert code == 0 and len(said["result"]["sections"]) == len(catalog.CATALOG)


def test_bridge_runs_tools(spark, tmp_path):
    r = runner.registry(spark)
    long = str(tmp_path / "long.parquet")
    r.run("synthetic_data_generation.run", {"technique": "trend_patterns", "n_samples": 30, "n_waves": 3, "output_path": long})
    out = r.run("pivot_long_to_wide.run", {"input_path": long, "output_path": str(tmp_path / "wide.csv"), "time_label": "w"})
    assert out["columns"] == ["subject_id", "depressive_score_w1", "depressive_score_w2", "depressive_score_w3"]
    r.run("build_trajectories.run", {"technique": "lcga", "input_path": long, "output_path": str(tmp_path / "t.csv"), "n_trajectories": 2, "builder_kwargs_json": '{"n_init": 2}'})
    r.run("combine_dataset_with_trajectories.run", {"input_original_data_path": long, "input_trajectories_data_path": str(tmp_path / "t.csv"), "output_path": str(tmp_path / "c.parquet")})
    both = spark.read.parquet(str(tmp_path / "c.parquet"))
    assert both.count() == 90 and both.filter("trajectory_id IS NULL").count() == 0
    for t in ("mean_profiles", "class_spaghetti", "trajectory_sizes"):
        r.run("trajectories_viz.run", {"technique": t, "input_path": str(tmp_path / "c.parquet"), "output_html": str(tmp_path / f"{t}.html")})
        assert "<svg" in (tmp_path / f"{t}.html").read_text() or t == "trajectory_sizes"
    r.run("show_table.run", {"input_path": long, "output_html": str(tmp_path / "s.html")})
    assert r.run("missing_imputation.run", {"technique": "mean_imputation", "input_path": long, "output_path": str(tmp_path / "i.csv")})["missing_after"] == 0
    assert len(r.run("longitudinal_machine_learning.run", {"technique": "list_estimators"})["estimators"]) == 47
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        r.run("pivot_long_to_wide.run", {"input_path": long, "output_path": str(tmp_path / "wide.csv")})
    with pytest.raises(OperationNotFoundError):
        catalog.with_defaults("clean_dataset", "odd", {})
    assert len(r.names()) >= 47


def test_streams(spark, tmp_path):
    schema = "k long, v double, ts timestamp"
    rows = [(1, 1.0, "2020-01-01"), (1, 1.0, "2020-01-01"), (2, -9.0, "2020-01-02"), (3, None, "2020-03-01")]
    spark.createDataFrame(rows, "k long, v double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    from pyspark.sql.types import _parse_datatype_string

    stream = incremental.read_deliveries(spark, str(tmp_path / "in"), _parse_datatype_string(schema))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    assert sorted(r[0] for r in run(incremental.distinct_deliveries(stream, ["k"], "ts"), "once", "append")) == [1, 2, 3]
    rates = run(incremental.windowed_missing_rate(stream, ["v"], "ts", codes=[-9]), "rates", "complete")
    assert sum(r[1] for r in rates) == 4 and sum(r[2] for r in rates) == 2
