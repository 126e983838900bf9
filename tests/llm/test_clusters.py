import numpy as np
import pytest

from panelforge.core.errors import InputValidationError
from panelforge.llm.clusters import box_pairs, cliques, density_clusters, describe_clusters

DIMS = 6


def frame(spark, vectors, ids=None):
    rows = [(int(i), [None if x is None else float(x) for x in v] if v is not None else None, "extra") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "id long, v array<double>, cluster_id string")


def brute(x):
    n, parent = len(x), list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.abs(x[i + 1 :] - x[i]).max(1) <= 1 + 1e-9):
            a, b = root(i), root(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def planted(seed, groups=12):
    """Groups more than 2 apart in the first coordinate, some of them chains longer than 2."""
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.uniform(-8, 8, DIMS)
        base[0] = 9.0 * g
        n = int(rng.integers(1, 25))
        if g % 3 == 0:
            out += [base + np.r_[0, np.full(DIMS - 1, 0.9 * k)] for k in range(n)]
        else:
            out += list(base + rng.uniform(-0.4, 0.4, (n, DIMS)))
    x = np.array(out)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed,chunk", [(0, 4000), (1, 30)])
def test_clusters_against_brute_force(spark, seed, chunk):
    x = planted(seed)
    got = {r["id"]: r["cluster_id"] for r in density_clusters(frame(spark, x), "id", "v", dims=DIMS, chunk=chunk).collect()}
    assert got == brute(x)


def test_one_cluster_of_most_records_in_small_chunks(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.uniform(0, 0.8, (400, DIMS)), 50 + 9 * np.arange(20)[:, None] * np.ones(DIMS)])
    got = {r["id"]: r["cluster_id"] for r in density_clusters(frame(spark, x), "id", "v", dims=DIMS, chunk=50).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[i] == i for i in range(400, 420))


def test_ties_repeats_nulls_and_empty(spark):
    rows = [[0.0] * DIMS, [1.0] * DIMS, [3.5] * DIMS, None, [0.0] * 5, [float("nan")] + [0.0] * 5, [None] + [0.0] * 5]
    df = frame(spark, rows)
    got = {r["id"]: r["cluster_id"] for r in density_clusters(df.union(df), "id", "v", dims=DIMS).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert density_clusters(frame(spark, []), "id", "v", dims=DIMS).count() == 0


def test_medoids_by_brute_force(spark):
    x = planted(7)
    df = frame(spark, x).drop("cluster_id")
    clusters = density_clusters(df, "id", "v", dims=DIMS)
    labels = brute(x)
    for r in describe_clusters(clusters, df, "id", "v", dims=DIMS).collect():
        own = [i for i, c in labels.items() if c == r["cluster_id"]]
        cost = {i: ((x[own] - x[i]) ** 2).sum() for i in own}
        assert r["n_members"] == len(own)
        assert cost[r["medoid"]] == pytest.approx(min(cost.values()))
        assert r["typical_members"].split(",")[0] == str(r["medoid"]) and len(r["typical_members"].split(",")) == min(3, len(own))


def dbscan(x, eps, least):
    """Brute force over all pairs: core points, their components, border points to the component of the least core."""
    near = np.abs(x[:, None] - x[None]).max(2) <= eps + 1e-9
    core = near.sum(1) >= least
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += [int(j) for j in np.flatnonzero(near[k] & core) if j not in label]
    for i in np.flatnonzero(~core):
        own = [label[j] for j in np.flatnonzero(near[i] & core)]
        label[i] = min(own) if own else None
    least_of = {}
    for i, c in label.items():
        if c is not None:
            least_of[c] = min(least_of.get(c, i), i)
    return {int(i): int(i if c is None else least_of[c]) for i, c in label.items()}


@pytest.mark.parametrize("seed,least,chunk", [(1, 2, 60), (3, 4, 4000), (4, 6, 40)])
def test_any_data_against_brute_force(spark, seed, least, chunk):
    """Clouds without gaps between clusters: boxes do not decide, members are compared; cells are split."""
    rng = np.random.default_rng(seed)
    dims = 3
    x = np.vstack([rng.uniform(0, 9, (220, dims)), rng.normal(4, 0.7, (120, dims)), np.repeat(rng.uniform(12, 30, (4, dims)), 5, 0)])
    x = x[rng.permutation(len(x))]
    got = {r["id"]: r["cluster_id"] for r in density_clusters(frame(spark, x), "id", "v", dims=dims, eps=0.8, min_points=least, chunk=chunk).collect()}
    assert got == dbscan(x, 0.8, least)


def test_records_further_apart_than_eps_stay_apart(spark):
    got = {r["id"]: r["cluster_id"] for r in density_clusters(frame(spark, [[0.0] * DIMS, [1.5] * DIMS, [2.5] * DIMS]), "id", "v", dims=DIMS, eps=1.0).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_a_third_of_equal_records_and_a_crowded_cell(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([np.zeros((300, DIMS)), 5 + rng.uniform(0, 0.9, (300, DIMS)), rng.uniform(20, 60, (300, DIMS))])
    got = {r["id"]: r["cluster_id"] for r in density_clusters(frame(spark, x), "id", "v", dims=DIMS, chunk=100).collect()}
    assert got == dbscan(x, 1.0, 2)


def test_kernels():
    rng = np.random.default_rng(0)
    lo = rng.uniform(0, 6, (90, DIMS))
    hi = lo + rng.uniform(0, 1, (90, DIMS))
    a, b = box_pairs(lo, hi, 1.0, block=7)
    want = {(i, j) for i in range(90) for j in range(i) if (np.maximum(lo[i], lo[j]) - np.minimum(hi[i], hi[j])).max() <= 1 + 1e-9}
    assert {(max(i, j), min(i, j)) for i, j in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
    p = rng.uniform(0, 4, (80, 2))
    box = cliques(p, 1.0)
    assert all(np.ptp(p[box == k], axis=0).max() <= 1 + 1e-9 for k in range(box.max() + 1)) and (box >= 0).all()
    assert len(cliques(np.zeros((0, DIMS)), 1.0)) == 0
    with pytest.raises(InputValidationError):
        density_clusters(None, "id", "v", dims=2, min_points=0)
