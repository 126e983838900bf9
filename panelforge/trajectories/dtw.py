"""k-means of series under dynamic time warping with barycentre averaging.

Sakoe and Chiba 1978 for the distance, Petitjean et al. 2011 for the barycentres. Each round is one pass over the
series: a task aligns its series to the centroids, vectorised over a batch, and sends back only sums per centroid point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.trajectories.base import TrajectoryResult, subject_series, trajectory_names


def warp(x: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared warping distance of each series (n, T, F) to one centroid (S, F), and the cumulative costs (n, T, S)."""
    local = ((x[:, :, None, :] - centroid[None, None]) ** 2).sum(-1)
    n, t, s = local.shape
    acc = np.empty_like(local)
    for i in range(t):
        for j in range(s):
            if i == j == 0:
                before = 0.0
            elif i == 0:
                before = acc[:, 0, j - 1]
            elif j == 0:
                before = acc[:, i - 1, 0]
            else:
                before = np.minimum(np.minimum(acc[:, i - 1, j], acc[:, i, j - 1]), acc[:, i - 1, j - 1])
            acc[:, i, j] = local[:, i, j] + before
    return acc[:, -1, -1], acc


def align(acc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (S, F) and counts (S) of the series points that the best paths put on each centroid point."""
    n, t, s = acc.shape
    i, j = np.full(n, t - 1), np.full(n, s - 1)
    sums, counts, rows = np.zeros((s, x.shape[2])), np.zeros(s), np.arange(n)
    alive = np.ones(n, bool)
    while alive.any():
        r = rows[alive]
        np.add.at(sums, j[r], x[r, i[r]])
        np.add.at(counts, j[r], 1)
        done = (i[r] == 0) & (j[r] == 0)
        alive[r[done]] = False
        r = r[~done]
        up = np.where(i[r] > 0, acc[r, np.maximum(i[r] - 1, 0), j[r]], np.inf)
        left = np.where(j[r] > 0, acc[r, i[r], np.maximum(j[r] - 1, 0)], np.inf)
        both = np.where((i[r] > 0) & (j[r] > 0), acc[r, np.maximum(i[r] - 1, 0), np.maximum(j[r] - 1, 0)], np.inf)
        step = np.argmin(np.stack([both, up, left]), 0)
        i[r] -= (step != 2).astype(int)
        j[r] -= (step != 1).astype(int)
    return sums, counts


def labels_of(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([warp(x, c)[0] for c in centroids], 1)
    return d.argmin(1), d.min(1)


def _sums(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts of aligned points per centroid point, and the summed distance to the nearest centroids."""
    k, s, f = centroids.shape
    total, counts = np.zeros((k, s, f)), np.zeros((k, s))
    warped = [warp(x, c) for c in centroids]
    d = np.stack([w[0] for w in warped], 1)
    label = d.argmin(1)
    for c in range(k):
        own = label == c
        if own.any():
            total[c], counts[c] = align(warped[c][1][own], x[own])
    return total, counts, float(d.min(1).sum())


@dataclass
class DtwKMeans:
    n_trajectories: int | None = 3
    random_state: int | None = 42
    max_iter: int = 10
    n_init: int = 4
    init_sample: int = 2000
    tolerance: float = 1e-6
    trajectory_names: Sequence[str] | None = None
    max_value_cols = 0

    def __post_init__(self) -> None:
        if not self.n_trajectories or self.n_trajectories < 1:
            raise InputValidationError("n_trajectories must be positive")

    def fit(self, df: DataFrame, id_col: str, time_col: str, values: Sequence[str]) -> TrajectoryResult:
        """Complete panels of at least two times. Starts from a k-means++ choice among ``init_sample`` subjects taken by
        a hash; every later round reads all subjects."""
        series = cut(subject_series(df, id_col, time_col, values))
        seed, k = self.random_state or 0, self.n_trajectories
        sample = series.orderBy(F.xxhash64("subject_id", F.lit(seed)), "subject_id").limit(self.init_sample).collect()
        if len(sample) < k:
            raise InputValidationError("fewer subjects than trajectories")
        times = sample[0]["times"]
        if len(times) < 2:
            raise InputValidationError("at least two times are needed")
        x = np.array([r["series"] for r in sample], float)
        centroids = self._best_start(x, np.random.default_rng(seed), k)
        last = np.inf
        for _ in range(self.max_iter):
            sums, counts, inertia = self._round(series, centroids)
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(1, counts)[:, :, None], centroids)
            empty = counts.sum(1) == 0
            if empty.any():  # the sample series that are farthest from their centroids start anew
                far = np.argsort(-labels_of(x, new)[1], kind="stable")
                new[empty] = x[far[: int(empty.sum())]]
            moved = np.abs(new - centroids).max()
            centroids = new
            if not empty.any() and (moved < 1e-9 or last - inertia <= self.tolerance * max(inertia, 1e-12)):
                break
            last = inertia
        return self._result(series, centroids, times)

    def assign(self, df: DataFrame, id_col: str, time_col: str, values: Sequence[str], parameters: dict) -> TrajectoryResult:
        return self._result(subject_series(df, id_col, time_col, values), np.array(parameters["centroids"], float), parameters["times"])

    def _best_start(self, x: np.ndarray, rng: np.random.Generator, k: int) -> np.ndarray:
        """The best of ``n_init`` short runs on the sample, each from a k-means++ choice."""
        best, least = None, np.inf
        for _ in range(self.n_init):
            c = self._start(x, rng, k)
            for _ in range(5):
                sums, counts, inertia = _sums(x, c)
                c = np.where(counts[:, :, None] > 0, sums / np.maximum(1, counts)[:, :, None], c)
            if inertia < least:
                best, least = c, inertia
        return best

    def _start(self, x: np.ndarray, rng: np.random.Generator, k: int) -> np.ndarray:
        chosen = [x[rng.integers(len(x))]]
        while len(chosen) < k:
            d = labels_of(x, np.array(chosen))[1]
            chosen.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
        return np.array(chosen)

    def _round(self, series: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k, s, f = centroids.shape

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, counts, inertia = np.zeros((k, s, f)), np.zeros((k, s)), 0.0
            for pdf in batches:
                if not len(pdf):
                    continue
                a, n, i = _sums(np.array([[list(p) for p in v] for v in pdf["series"]], float), centroids)
                total, counts, inertia = total + a, counts + n, inertia + i
            yield pd.DataFrame({"c": [0], "sums": [total.ravel()], "counts": [counts.ravel()], "inertia": [inertia]})

        rows = series.select("series").mapInPandas(sums, "c int, sums array<double>, counts array<double>, inertia double")
        add = rows.groupBy("c").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(k * s * f))).alias("s"), F.array(*(F.sum(F.col("counts")[i]) for i in range(k * s))).alias("n"), F.sum("inertia").alias("i")).first()
        return np.array(add["s"]).reshape(k, s, f), np.array(add["n"]).reshape(k, s), add["i"]

    def _result(self, series: DataFrame, centroids: np.ndarray, times: Sequence[float]) -> TrajectoryResult:
        names = trajectory_names(len(centroids), self.trajectory_names)

        @F.pandas_udf("long")
        def label(s: pd.Series) -> pd.Series:
            x = np.array([[list(p) for p in v] for v in s], float)
            return pd.Series(labels_of(x, centroids)[0])

        name = F.get(F.array(*map(F.lit, names)), F.col("trajectory_id").cast("int"))
        out = series.select("subject_id", label("series").alias("trajectory_id")).withColumn("trajectory_name", name)
        rows = [{"trajectory_id": c, "time": t, "outcome": f, "value": float(centroids[c, i, f])} for c in range(len(centroids)) for i, t in enumerate(times) for f in range(centroids.shape[2])]
        return TrajectoryResult(out, rows, {"centroids": centroids.tolist(), "times": list(times)})
