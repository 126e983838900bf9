"""Hierarchical clustering of series by splines.

Spark reduces every subject to cross products of a B-spline basis with itself and with the standardised outcomes; the
merge costs depend on nothing else. Agglomeration runs on the driver over at most ``max_exact`` leaves; larger panels are first
condensed to that many micro-clusters of subjects with like coefficients, whose cross products are sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.trajectories.base import TrajectoryResult, subject_series, trajectory_names


def bspline_basis(t: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis at ``t`` by the Cox-de Boor recursion; ``knots`` are the distinct ones, ends included."""
    full = np.r_[[knots[0]] * degree, knots, [knots[-1]] * degree].astype(float)
    n = len(full) - 1
    x = np.clip(np.asarray(t, float), knots[0], knots[-1])
    last = np.flatnonzero(full[:-1] < full[1:]).max()
    out = np.zeros((len(x), n))
    for i in range(n):
        out[:, i] = (full[i] <= x) & ((x < full[i + 1]) | ((i == last) & (x == full[i + 1])))
    for d in range(1, degree + 1):
        new = np.zeros((len(x), n - d))
        for i in range(n - d):
            if full[i + d] > full[i]:
                new[:, i] += (x - full[i]) / (full[i + d] - full[i]) * out[:, i]
            if full[i + d + 1] > full[i + 1]:
                new[:, i] += (full[i + d + 1] - x) / (full[i + d + 1] - full[i + 1]) * out[:, i + 1]
        out = new
    return out


def residuals(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Residual sums of squares (..., outcomes) of least squares from cross products; batched."""
    fitted = np.einsum("...pf,...pq,...qf->...f", xy, np.linalg.pinv(xx, hermitian=True), xy)
    return np.maximum(yy - fitted, 0.0)


@dataclass
class Leaves:
    """Clusters as stacked cross products; ``members`` holds the leaf indices of each."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: np.ndarray
    members: list[list[int]]

    def __post_init__(self) -> None:
        self.ssr = residuals(self.xx, self.xy, self.yy)


class Agglomeration:
    """Pairwise costs are computed once; a merge computes one new row."""

    def __init__(self, leaves: Leaves, weights: np.ndarray, metric: str, p: int):
        self.l, self.w, self.metric, self.p = leaves, weights, metric, p
        m = len(leaves.n)
        self.alive = np.ones(m, bool)
        self.cost = np.full((m, m), np.inf)
        for i in range(m - 1):
            self.cost[i, i + 1 :] = self._row(i, np.arange(i + 1, m))

    def _row(self, i: int, others: np.ndarray) -> np.ndarray:
        leaves = self.l
        both = residuals(leaves.xx[i] + leaves.xx[others], leaves.xy[i] + leaves.xy[others], leaves.yy[i] + leaves.yy[others])
        apart = leaves.ssr[i] + leaves.ssr[others]
        if self.metric == "sparse":
            return (both * self.w).sum(1) / (leaves.n[i] + leaves.n[others])
        if self.metric == "UnW":
            return ((both - apart) * self.w).sum(1)
        ratio = (both - apart) / np.where(apart == 0, 1e-8, apart)
        return (ratio * (leaves.n[i] + leaves.n[others] - 2 * self.p)[:, None] * self.w).sum(1)

    def merge(self, i: int, j: int) -> int:
        leaves = self.l
        for a in (leaves.xx, leaves.xy, leaves.yy, leaves.n):
            a[i] = a[i] + a[j]
        leaves.ssr[i] = residuals(leaves.xx[i], leaves.xy[i], leaves.yy[i])
        leaves.members[i] = leaves.members[i] + leaves.members[j]
        self.alive[j] = False
        self.cost[j, :] = self.cost[:, j] = np.inf
        others = np.flatnonzero(self.alive)
        others = others[others != i]
        if len(others):
            row = self._row(i, others)
            self.cost[np.minimum(i, others), np.maximum(i, others)] = row
        return i

    def cheapest(self) -> tuple[int, int]:
        return tuple(int(x) for x in np.unravel_index(np.argmin(self.cost), self.cost.shape))


def outcome_weights(how: str, raw: np.ndarray) -> np.ndarray:
    k = len(raw)
    if how == "equal" or (how == "standardise" and abs(raw.sum()) < 1e-8):
        return np.full(k, 1 / k)
    if how == "standardise":
        return raw / raw.sum()
    e = np.exp((raw - raw.mean()) / (raw.std() + 1e-8))
    return e / e.sum()


@dataclass
class SplineClusters:
    n_trajectories: int | None = None
    random_state: int | None = None
    spline_degree: int = 3
    n_internal_knots: int = 3
    dist_metric: str = "W"
    preprocess: bool = True
    weight_func: str = "standardise"
    selection_metric: str = "gapb"
    max_exact: int = 2000
    trajectory_names: Sequence[str] | None = None
    max_value_cols = 0

    def __post_init__(self) -> None:
        if self.dist_metric not in ("W", "UnW") or self.weight_func not in ("standardise", "softmax", "equal") or self.selection_metric.lower() not in ("gapb", "ch"):
            raise InputValidationError("unknown metric, weighting or selection")

    def fit(self, df: DataFrame, id_col: str, time_col: str, values: Sequence[str]) -> TrajectoryResult:
        """Subjects with any missing value get null labels; the others may have any times."""
        series = cut(subject_series(df, id_col, time_col, values, complete=False))
        usable = series.filter("is_complete")
        f = len(values)
        points = usable.select(F.explode(F.arrays_zip("times", "series")).alias("x"))
        quantiles = [q / (self.n_internal_knots + 1) for q in range(1, self.n_internal_knots + 1)]
        moments = points.agg(F.min("x.times").alias("lo"), F.max("x.times").alias("hi"), F.percentile("x.times", F.array(*map(F.lit, quantiles))).alias("q"), F.count(F.lit(1)).alias("n"), *(F.avg(F.col("x.series")[i]).alias(f"m{i}") for i in range(f)), *(F.stddev_pop(F.col("x.series")[i]).alias(f"s{i}") for i in range(f))).first()
        if not moments["n"]:
            raise InputValidationError("no subject is complete")
        knots = np.unique([moments["lo"], *moments["q"], moments["hi"]])
        if len(knots) != self.n_internal_knots + 2:
            raise InputValidationError("the times have too few distinct quantiles for so many knots")
        mean = np.array([moments[f"m{i}"] for i in range(f)])
        sd = np.array([moments[f"s{i}"] or 1.0 for i in range(f)])
        degree = self.spline_degree
        p = self.n_internal_knots + degree + 1

        @F.pandas_udf("array<double>")
        def cross(times: pd.Series, rows: pd.Series) -> pd.Series:
            out = []
            for t, v in zip(times, rows):
                b = bspline_basis(np.array(t), knots, degree)
                y = (np.array([list(x) for x in v], float) - mean) / sd
                out.append(np.concatenate([(b.T @ b).ravel(), (b.T @ y).ravel(), (y**2).sum(0), [len(t)]]))
            return pd.Series(out)

        stats = cut(usable.select("subject_id", cross("times", "series").alias("c")))
        n = stats.count()
        if n > self.max_exact:
            stats = self._condense(stats, p, f)
            grouped = stats.groupBy("leaf").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(p * p + p * f + f + 1))).alias("c")).orderBy("leaf").collect()
            keys = [r["leaf"] for r in grouped]
        else:
            grouped = stats.orderBy("subject_id").collect()
            keys = [r["subject_id"] for r in grouped]
            stats = stats.withColumn("leaf", F.col("subject_id"))
        c = np.array([r["c"] for r in grouped], float)
        leaves = Leaves(c[:, : p * p].reshape(-1, p, p), c[:, p * p : p * p + p * f].reshape(-1, p, f), c[:, -f - 1 : -1].copy(), c[:, -1].copy(), [[i] for i in range(len(c))])
        label, diagnostics = self._cluster(leaves, p, f)
        names = trajectory_names(max(label) + 1, self.trajectory_names)
        table = df.sparkSession.createDataFrame([(keys[i], int(x), names[x]) for i, x in enumerate(label)], "leaf " + dict(stats.dtypes)["leaf"] + ", trajectory_id long, trajectory_name string")
        labelled = stats.select("subject_id", "leaf").join(table, "leaf").drop("leaf")
        return TrajectoryResult(series.select("subject_id").join(labelled, "subject_id", "left"), [], {}, diagnostics)

    def assign(self, *_args, **_kwargs) -> TrajectoryResult:
        raise InputValidationError("spline clusters have no parameters to assign new subjects by; fit them again")

    def _condense(self, stats: DataFrame, p: int, f: int) -> DataFrame:
        """Micro-clusters by k-means of (time-weighted) outcome projections, standardised: an approximation for large panels."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        lo = p * p + 1
        scaled = stats.withColumn("v", array_to_vector(F.transform(F.slice("c", lo, p * f), lambda x: x / F.element_at("c", -1))))
        model = KMeans(k=self.max_exact, seed=self.random_state or 1, featuresCol="v", predictionCol="leaf", maxIter=20).fit(scaled)
        return cut(model.transform(scaled).select("subject_id", "c", "leaf"))

    def _cluster(self, leaves: Leaves, p: int, f: int) -> tuple[list[int], list[dict]]:
        everything = (leaves.xx.sum(0), leaves.xy.sum(0), leaves.yy.sum(0))
        ssr_all, total = residuals(*everything), float(leaves.n.sum())
        own = leaves.ssr.sum(0)
        weights = np.full(f, 1 / f) if leaves.n.max() <= p else outcome_weights(self.weight_func, ssr_all / np.where(own == 0, 1e-8, own) - 1)
        if self.preprocess and (leaves.n <= p).any() and len(leaves.n) > 1:
            leaves = self._thicken(leaves, weights, p)
            thick = leaves.n > p
            if thick.any():
                own = leaves.ssr[thick].sum(0)
                weights = outcome_weights(self.weight_func, residuals(leaves.xx[thick].sum(0), leaves.xy[thick].sum(0), leaves.yy[thick].sum(0)) / np.where(own == 0, 1e-8, own) - 1)
        first = len(leaves.n)
        sigma = float((leaves.ssr.sum(0) * weights).sum() / max(total - first * p, 1.0))
        tree = Agglomeration(leaves, weights, self.dist_metric, p)
        beta_all = np.linalg.pinv(everything[0]) @ everything[1]
        states: dict[int, list[list[int]]] = {}
        rows: dict[int, dict] = {}
        while True:
            at = np.flatnonzero(tree.alive)
            k = len(at)
            states[k] = [list(leaves.members[i]) for i in at]
            xx, xy, yy, ssr = leaves.xx[at], leaves.xy[at], leaves.yy[at], leaves.ssr[at]
            without = residuals(everything[0] - xx, everything[1] - xy, everything[2] - yy)
            gap = float(((ssr_all - without - ssr) * weights).sum())
            diff = beta_all - np.linalg.pinv(xx, hermitian=True) @ xy
            between = float((np.einsum("kpf,kpq,kqf->kf", diff, xx, diff) * weights).sum())
            within = float((ssr * weights).sum())
            per = within / max(total - k * p, 1)
            ch = (between / (k - 1)) / per if k > 1 and per > 1e-12 else 0.0
            rows[k] = {"n_clusters": k, "gap_b": gap - k * p * sigma, "ch_index": ch, "gap_distance": gap, "between_distance": between, "within_distance": within}
            if k == 1:
                break
            tree.merge(*tree.cheapest())
        chosen, by = self._choose(rows)
        label = [0] * sum(len(m) for m in states[chosen])
        for x, members in enumerate(sorted(states[chosen], key=min)):
            for i in members:
                label[i] = x
        return label, [rows[k] | {"selected_k": chosen, "selection_metric": by, "is_selected": k == chosen} for k in sorted(rows)]

    def _thicken(self, leaves: Leaves, weights: np.ndarray, p: int) -> Leaves:
        """Merge leaves with too few observations for a spline of their own into their cheapest partners."""
        tree = Agglomeration(leaves, weights, "sparse", p)
        while tree.alive.sum() > 1:
            thin = np.flatnonzero(tree.alive & (leaves.n <= p))
            if not len(thin):
                break
            cost = np.minimum(tree.cost[thin, :].min(1), tree.cost[:, thin].min(0))
            i = int(thin[np.argmin(cost)])
            row = np.minimum(tree.cost[i, :], tree.cost[:, i])
            j = int(np.argmin(row))
            tree.merge(min(i, j), max(i, j))
        at = np.flatnonzero(tree.alive)
        return Leaves(leaves.xx[at].copy(), leaves.xy[at].copy(), leaves.yy[at].copy(), leaves.n[at].copy(), [leaves.members[i] for i in at])

    def _choose(self, rows: dict[int, dict]) -> tuple[int, str]:
        most = max(rows)
        if self.n_trajectories is not None:
            if self.n_trajectories > most:
                raise InputValidationError(f"only {most} clusters are left for {self.n_trajectories} trajectories")
            return self.n_trajectories, "fixed"
        if self.selection_metric.lower() == "ch":
            return (max((k for k in rows if k > 1), key=lambda k: rows[k]["ch_index"]) if most > 1 else 1), "ch"
        for k in range(2, most):
            if rows[k]["gap_b"] > rows[k - 1]["gap_b"] and rows[k]["gap_b"] > rows[k + 1]["gap_b"]:
                return k, "gapb"
        return max(rows, key=lambda k: rows[k]["gap_b"]), "gapb"
