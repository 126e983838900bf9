import math

import numpy as np
import pytest

from panelforge.llm import mixing


def test_rates_are_tilted_by_length_from_one_base_rate(spark):
    """Against bisection of each source's goal; goals, caps and lengths differ, one length is far from the rest."""
    rng = np.random.default_rng(3)
    sizes = {"a": np.r_[rng.integers(5, 400, 300), 90_000], "b": rng.integers(1, 3000, 200), "c": rng.integers(50, 60, 40), "d": np.full(30, 7)}
    rows = [(s, int(t), int(n)) for s, x in sizes.items() for t, n in zip(*np.unique(x, return_counts=True))]
    parts = {"a": (0.02, 1), "b": (0.9, 4), "c": (0.6, 2), "d": (0.3, 3)}
    goals = {s: (share * cap * int(sizes[s].sum()), cap) for s, (share, cap) in parts.items()}
    got = mixing.balance(spark.createDataFrame(rows, "source string, tokens long, n long"), goals)
    for s, (goal, cap) in goals.items():
        t = sizes[s].astype(float)
        a, b = got[s]
        assert a == pytest.approx(-math.log(cap)) and abs(b) > 1e-7
        drawn = lambda b, t=t, cap=cap: float((cap * t * 0.5 * (1 + np.tanh((-math.log(cap) + b * t) / 2))).sum())
        lo, hi = -5.0, 5.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if drawn((lo + hi) / 2) < goal else (lo, (lo + hi) / 2)
        assert b == pytest.approx(lo, rel=1e-6) and drawn(b) == pytest.approx(goal, rel=1e-8)


def test_goals_that_the_base_rate_meets_need_no_tilt_and_extremes_have_none(spark):
    lengths = spark.createDataFrame([("a", 10, 5), ("a", 30, 5), ("b", 4, 2), ("c", 4, 2)], "source string, tokens long, n long")
    got = mixing.balance(lengths, {"a": (100.0, 1), "b": (16.0, 2), "c": (0.0, 2), "gone": (5.0, 1)})
    assert got["a"] == pytest.approx((0, 0), abs=1e-9)
    assert got["b"] == (math.inf, 0) and got["c"] == got["gone"] == (-math.inf, 0)
