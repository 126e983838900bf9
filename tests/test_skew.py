import pytest
from pyspark.sql import functions as F

from panelforge.operators.ranks import exact_rank
from panelforge.operators.references import check_references


@pytest.fixture
def small_partitions(spark):
    wanted = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_reference_key_with_a_third_of_the_rows_is_split(spark, small_partitions):
    refs = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("ref"))
    targets = spark.range(1000).select(F.col("id").alias("key"))
    out = check_references(refs.repartition(8), ["ref"], targets, ["key"])
    assert out.filter("cause = 'none'").count() == 66_667 + 666
    out = out.drop("cause_")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_ranks_in_more_buckets_are_the_same_kind_of_permutation(spark):
    df = spark.range(900).select((F.col("id") % 2).alias("g"), "id")
    got = exact_rank(df, ["g"], ["id"], rows=50_000 * 2**9).collect()
    for g in (0, 1):
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(450))
    small = {r["id"]: r["rank"] for r in exact_rank(df, ["g"], ["id"]).collect()}
    assert small == {r["id"]: r["rank"] for r in got}
