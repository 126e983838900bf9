import json
import math

import pytest
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.sources import files, synthetic


def test_csv_types_and_null_texts(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('i,d,b,t,e\n1,1.5,true,"x, ""y""",\nNA,nan,FALSE,NULL,N/A\n3,-2e3,true,1d,\n')
    df = files.read_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [r["i"] for r in df.collect()] == [1, None, 3] and [r["t"] for r in df.collect()] == ['x, "y"', None, "1d"]
    with pytest.raises(InputValidationError):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(InputValidationError):
        files.read_csv(spark, __file__)


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a", True), (2, None, None, False)], "i long, v double, s string, b boolean")
    files.write_csv(df, str(tmp_path / "x.csv"))
    assert files.read_csv(spark, str(tmp_path / "x.csv")).orderBy("i").collect() == df.orderBy("i").collect()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_csv(df, str(tmp_path / "x.csv"))
    files.write_stata(df, str(tmp_path / "x.dta"))
    back = files.read_stata(spark, str(tmp_path / "x.dta"))
    assert [(r["i"], r["v"], r["s"]) for r in back.orderBy("i").collect()] == [(1.0, 2.5, "a"), (2.0, None, None)]
    (tmp_path / "empty.dta").write_bytes(b"")
    (tmp_path / "broken.dta").write_bytes(b"not stata at all")
    for name in ("empty", "broken"):
        with pytest.raises(InputValidationError):
            files.read_stata(spark, str(tmp_path / f"{name}.dta"))
    with pytest.raises(InputValidationError):
        files.write_stata(df, str(tmp_path / "y.dta"), row_limit=1)


def test_conversion_of_files_and_folders(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in/sub/b.csv").write_text("x,y\n3,4\n")
    done = files.convert(spark, "csv_to_parquet", run_mode="file", input_path=str(tmp_path / "in/a.csv"))
    assert done.converted == [str(tmp_path / "in/a.parquet")] and spark.read.parquet(done.converted[0]).count() == 1
    done = files.convert(spark, "csv_to_stata", run_mode="batch", input_folder=str(tmp_path / "in"), output_folder=str(tmp_path / "out"), include_subfolders=True)
    assert [x.removeprefix(str(tmp_path)) for x in done.converted] == ["/out/a.dta", "/out/sub/b.dta"]
    with pytest.raises(InputValidationError):
        files.convert(spark, "stata_to_csv", run_mode="folder", input_folder=str(tmp_path / "in"))
    with pytest.raises(InputValidationError):
        files.convert(spark, "csv_to_excel", input_path="x")
    with pytest.raises(InputValidationError):
        files.convert(spark, "csv_to_parquet", run_mode="odd", input_path="x")


def test_manifest(tmp_path):
    (tmp_path / "A.dta").write_text("")
    assert list(files.check_manifest(str(tmp_path), ["a.dta"])) == ["a.dta"]
    with pytest.raises(InputValidationError, match="b.dta"):
        files.check_manifest(str(tmp_path), ["a.dta", "b.dta"])


@pytest.mark.parametrize("name", synthetic.GENERATORS)
def test_generators_repeat_and_do_not_depend_on_partitions(spark, name):
    a = sorted(map(tuple, synthetic.generate(spark, name, n_samples=40).collect()), key=str)
    b = sorted(map(tuple, synthetic.generate(spark, name, n_samples=40).repartition(7).collect()), key=str)
    more = {tuple(r)[:2] for r in synthetic.generate(spark, name, n_samples=41).collect()}
    assert a == b and {r[:2] for r in a} <= more
    assert a != sorted(map(tuple, synthetic.generate(spark, name, n_samples=40, random_state=1).collect()), key=str)


def test_trend_classes_have_their_lines(spark):
    df = synthetic.trend_patterns(spark, n_samples=4000, n_waves=4, keep_class=True)
    got = {(r["true_class"], r["wave"]): r["m"] for r in df.groupBy("true_class", "wave").agg(F.avg("depressive_score").alias("m")).collect()}
    for i, (_, level, slope, _) in enumerate(synthetic.DEFAULT_CLASSES):
        for w in range(1, 5):
            assert got[i, w] == pytest.approx(level + slope * (w - 1), abs=0.3)
    shares = {r["true_class"]: r["count"] / 4000 for r in df.filter("wave = 1").groupBy("true_class").count().collect()}
    assert shares[0] == pytest.approx(0.75, abs=0.03)
    custom = json.dumps([{"name": "x", "intercept": 1, "slope": 0, "proportion": 1}])
    assert synthetic.trend_patterns(spark, n_samples=5, spec_mode="custom", custom_class_specs_json=custom).count() == 20
    with pytest.raises(InputValidationError):
        synthetic.class_specs("custom", "[{}]")


def test_missing_rates(spark):
    df = synthetic.missing_data_scenarios(spark, n_samples=3000, mechanism="mcar", missing_rate=0.2)
    assert df.agg(F.avg(F.col("sleep_score").isNull().cast("double"))).first()[0] == pytest.approx(0.2, abs=0.02)
    drop = synthetic.missing_data_scenarios(spark, n_samples=500, mechanism="dropout", dropout_rate=0.5)
    gone = drop.groupBy("subject_id").agg(F.min(F.when(F.col("sleep_score").isNull(), F.col("wave"))).alias("a"), F.max(F.when(F.col("sleep_score").isNotNull(), F.col("wave"))).alias("b"))
    assert gone.filter("a < b").count() == 0 and gone.filter("a IS NOT NULL").count() == pytest.approx(250, abs=40)
    with pytest.raises(InputValidationError):
        synthetic.event_shock_recovery(spark, shock_wave=9)


def test_normal_numbers(spark):
    r = spark.range(20000).select(synthetic.normal(1, "x", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z"), F.avg(F.pow("z", 4))).first()
    assert r[0] == pytest.approx(0, abs=0.03) and r[1] == pytest.approx(1, abs=0.03) and r[2] == pytest.approx(3, abs=0.3)
    assert math.isfinite(r[0])
