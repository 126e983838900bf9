from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import impute


def test_tied_predictions_draw_every_observed_value_in_proportion(spark):
    """One prediction for all: the donors hold -9 in a tenth of the rows, and so must the filled cells."""
    rows = [(k, 1.0, float([-9, 3, 4, 4, 5, 5, 5, 6, 6, 7][k % 10]) if k < 4000 else None) for k in range(8000)]
    out = impute.impute(spark.createDataFrame(rows, "id long, x double, y double"), "mice_imputation", columns=["x", "y"])
    got = Counter(r["y"] for r in out.filter("id >= 4000").collect())
    assert set(got) == {-9.0, 3.0, 4.0, 5.0, 6.0, 7.0}
    assert abs(got[-9.0] / 4000 - 0.1) < 0.02 and abs(got[5.0] / 4000 - 0.3) < 0.03


def test_draws_are_among_the_nearest_rows_as_by_brute_force():
    rng = np.random.default_rng(5)
    p = np.sort(rng.integers(0, 40, 150) / 4)
    points, n = np.unique(p, return_counts=True)
    rows = np.r_[0, np.cumsum(n)]
    wanted = rng.uniform(-1, 11, 400).round(2)
    for k in (1, 5, 300):
        got = impute.draw_donors(points, rows, wanted, rng.integers(-(1 << 62), 1 << 62, 400), k, 7)
        far = np.sort(abs(p - wanted[:, None]), axis=1)[:, min(k, len(p)) - 1]
        assert (abs(p[got] - wanted) <= far + 1e-12).all()
    one = impute.draw_donors(points, rows, np.full(20_000, 5.1), np.arange(20_000), 5, 7)
    near = np.argsort(abs(p - 5.1), kind="stable")[:5]
    assert set(p[one]) == set(p[near])
    for v in set(p[near]):
        assert abs((p[one] == v).mean() - (p[near] == v).mean()) < 0.02


def test_ranges_of_donors_give_the_result_of_all_at_once(spark):
    seen = spark.range(3000).select((F.col("id") % 700 / 7).alias("p"), (F.col("id") % 11).cast("double").alias("y")).cache()
    ask = spark.range(500).select((F.col("id") / 4.9 - 1).alias("q"), F.xxhash64("id").alias("__row"))
    whole, ranged = (sorted(map(tuple, ask.select("q", impute._matched(seen, F.col("q"), 5, 3, m)).collect())) for m in (10**6, 300))
    assert whole == ranged
