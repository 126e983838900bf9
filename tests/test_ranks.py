import random

import pytest

from panelforge.operators.ranks import exact_quantiles, exact_rank, prefix_counts


def test_prefix_counts_and_quantiles_against_sorting(spark):
    rng = random.Random(4)
    data = {g: [rng.choice([rng.random(), float(rng.randrange(5))]) for _ in range(n)] for g, n in ((1, 400), (2, 3), (None, 50))}
    rows = [(g, v, own.count(v)) for g, own in data.items() for v in set(own)]
    df = spark.createDataFrame(rows, "g long, v double, n long")
    for r in prefix_counts(df, ["g"], "v", ["n"]).collect():
        own = data[r["g"]]
        assert (r["n_before"], r["n_all"]) == (sum(x < r["v"] for x in own), len(own))
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["g"], "v", "n", [0.5, 0.9]).collect()}
    low = {r["g"]: r["q0"] for r in exact_quantiles(df, ["g"], "v", "n", [0.5], midpoint=False).collect()}
    for g, own in data.items():
        s = sorted(own)
        for q, have in zip((0.5, 0.9), got[g]):
            at = (len(s) - 1) * q
            a, b = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert have == pytest.approx(a + (b - a) * (at - int(at)))
        assert low[g] == s[-(-len(s) // 2) - 1]
    assert prefix_counts(df.limit(0), ["g"], "v", ["n"]).count() == 0


def test_ranks_depend_on_the_seed_only(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(300)], "g long, k long")
    runs = [{r["k"]: r["rank"] for r in exact_rank(d, ["g"], ["k"], seed=s).collect()} for d, s in ((df, 1), (df.repartition(9), 1), (df, 2))]
    assert runs[0] == runs[1] != runs[2]
    assert sorted(runs[0][k] for k in range(0, 300, 2)) == list(range(150))
