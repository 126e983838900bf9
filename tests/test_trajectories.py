from collections import Counter
from math import comb

import numpy as np
import pytest

from panelforge.core.errors import InputValidationError, OperationNotFoundError
from panelforge.sources.synthetic import trend_patterns
from panelforge.trajectories import mixture, spline
from panelforge.trajectories.base import build_trajectories, class_sizes_warning, trajectory_names
from panelforge.trajectories.dtw import align, warp


def rand_index(a, b):
    n, pairs = len(a), lambda c: sum(comb(v, 2) for v in c.values())
    x, p, q = pairs(Counter(zip(a, b))), pairs(Counter(a)), pairs(Counter(b))
    e = p * q / comb(n, 2)
    return (x - e) / ((p + q) / 2 - e)


@pytest.fixture(scope="module")
def panel(spark):
    df = trend_patterns(spark, n_samples=250, n_waves=5, noise_sd=0.4, intercept_sd=0.3, slope_sd=0.08, keep_class=True).cache()
    return df, {r["subject_id"]: r["true_class"] for r in df.filter("wave = 1").collect()}


@pytest.mark.parametrize("name,kwargs,least", [("lcga", {"n_init": 8}, 0.9), ("gmm", {"n_init": 8}, 0.9), ("gmm", {"random_effects": "intercept_slope"}, 0.8), ("clustermld", {}, 0.8), ("dtw_kmeans", {"n_init": 6}, 0.4)])
def test_classes_are_recovered(panel, name, kwargs, least):
    df, true = panel
    r = build_trajectories(df.drop("true_class"), name, n_trajectories=4, builder_kwargs=kwargs)
    got = {x["subject_id"]: x["trajectory_id"] for x in r.assignments.collect()}
    assert set(got) == set(true) and rand_index([true[k] for k in got], list(got.values())) > least
    if name in ("lcga", "gmm"):
        first = r.assignments.first()
        assert sum(first[f"class_{i}"] for i in range(4)) == pytest.approx(1)
        assert r.diagnostics[0]["BIC"] > r.diagnostics[0]["AIC"] > 0


def test_em_raises_the_likelihood_and_the_distributed_run_agrees(spark, panel):
    df, _ = panel
    model = mixture.GrowthMixture(n_trajectories=2, n_init=2, max_iter=12)
    stats = mixture.growth_statistics(df, "subject_id", "wave", "depressive_score")
    s = np.array([[float(r[c]) for c in mixture.COLUMNS] for r in stats.collect()])
    p, last = mixture._start(s, 2, 1, np.random.default_rng(0)), -np.inf
    start = p
    for _ in range(15):
        total = mixture.totals(s, p)
        assert total[-1] >= last - 1e-6
        last, p = total[-1], mixture.next_parameters(total, p, False, True)
    a, la, _ = mixture.run(s, start, 6, False, True, 0.0)
    model.max_iter, model.tolerance = 6, 0.0
    b, lb, _ = model._run_all(stats, start, True)
    assert la == pytest.approx(lb) and a.beta == pytest.approx(b.beta)


def test_saved_models(panel, tmp_path):
    df, _ = panel
    path = str(tmp_path / "m/model.json")
    fit = build_trajectories(df.drop("true_class"), "lcga", n_trajectories=2, builder_kwargs={"n_init": 2}, save_model_path=path)
    again = build_trajectories(df.drop("true_class"), "from_saved_model", input_model_path=path, refit=False)
    key = lambda r: {x["subject_id"]: x["trajectory_id"] for x in r.assignments.collect()}
    assert key(fit) == key(again)
    assert key(build_trajectories(df.drop("true_class"), "from_saved_model", input_model_path=path)) == key(fit)
    with pytest.raises(InputValidationError):
        build_trajectories(df, "from_saved_model", input_model_path=str(tmp_path / "none"))


def test_incomplete_panels(spark):
    rows = [(i, t, float(i % 2 * 5 + t)) for i in range(30) for t in range(5)]
    df = spark.createDataFrame([*rows[:-1], (29, 4, None)], "subject_id long, wave long, v double")
    r = build_trajectories(df, "clustermld", n_trajectories=2)
    out = {x["subject_id"]: x["trajectory_id"] for x in r.assignments.collect()}
    assert out[29] is None and len(out) == 30 and {out[i] for i in range(0, 28, 2)} != {out[i] for i in range(1, 29, 2)}
    for name in ("dtw_kmeans", "lcga", "gmm"):
        with pytest.raises(InputValidationError):
            build_trajectories(df, name)
    with pytest.raises(OperationNotFoundError):
        build_trajectories(df, "odd")
    with pytest.raises(InputValidationError):
        build_trajectories(df, "lcga", builder_kwargs={"no_such": 1})


def test_warping_by_brute_force():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(4, 5, 2)), rng.normal(size=(4, 2))

    def paths(i, j):
        if (i, j) == (0, 0):
            return [[(0, 0)]]
        return [p + [(i, j)] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0 for p in paths(a, b)]

    d, acc = warp(x, c)
    for k in range(4):
        costs = {tuple(p): sum(((x[k, i] - c[j]) ** 2).sum() for i, j in p) for p in paths(4, 3)}
        best = min(costs, key=costs.get)
        assert d[k] == pytest.approx(costs[best])
        sums, counts = align(acc[k : k + 1], x[k : k + 1])
        assert counts.tolist() == [sum(j == s for _, j in best) for s in range(4)]


def test_spline_basis_and_residuals():
    t = np.linspace(0, 6, 50)
    b = spline.bspline_basis(t, np.array([0, 1.5, 3, 4.5, 6]), 3)
    assert b.shape == (50, 7) and b.sum(1) == pytest.approx(np.ones(50)) and (b >= -1e-12).all()
    y = t[:, None] ** 3 - 2 * t[:, None]
    assert spline.residuals(b.T @ b, b.T @ y, (y**2).sum(0)) == pytest.approx([0], abs=1e-5)


def test_names_and_small_classes(panel):
    assert trajectory_names(2) == ["cluster_0", "cluster_1"]
    with pytest.raises(InputValidationError):
        trajectory_names(2, ["a"])
    df, _ = panel
    r = build_trajectories(df.drop("true_class"), "lcga", n_trajectories=1, builder_kwargs={"trajectory_names": ["all"]})
    assert class_sizes_warning(r) == [] and r.assignments.filter("trajectory_name <> 'all'").count() == 0
