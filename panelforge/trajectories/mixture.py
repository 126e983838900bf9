"""Latent-class growth analysis and growth mixture models by expectation-maximisation.

Laird and Ware 1982; Muthen and Shedden 1999. A straight line needs six sums per subject (n, t, t2, y, ty, y2), so the panel
is read once. A step of the algorithm is one pass over the subjects' sums, vectorised within batches; only the classes'
totals come back. Starts are tried on a bounded sample of subjects, the best one is then run on all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.core.errors import InputValidationError
from panelforge.core.session import cut
from panelforge.operators.aggregate import growth_statistics
from panelforge.trajectories.base import TrajectoryResult, subject_series, trajectory_names

COLUMNS = ["n", "st", "stt", "sy", "sty", "syy"]


@dataclass
class Parameters:
    weight: np.ndarray  # K
    beta: np.ndarray  # K x 2
    sigma2: float
    cov: np.ndarray  # K x 2 x 2, zero without random effects
    effects: int  # 0, 1 (intercept) or 2 (intercept and slope)

    def plain(self) -> dict:
        return {"weight": self.weight.tolist(), "beta": self.beta.tolist(), "sigma2": self.sigma2, "cov": self.cov.tolist(), "effects": self.effects}

    @staticmethod
    def of(d: dict) -> Parameters:
        return Parameters(np.array(d["weight"]), np.array(d["beta"]), d["sigma2"], np.array(d["cov"]), d["effects"])


def _posterior_effects(s: np.ndarray, p: Parameters, k: int):
    """Per subject under class k: residual sum of squares, Z'r, and mean and variance of its random effects."""
    n, st, stt, sy, sty, syy = s.T
    a, b = p.beta[k]
    ssr = syy - 2 * a * sy - 2 * b * sty + n * a * a + 2 * a * b * st + b * b * stt
    ssr = np.maximum(ssr, 0.0)
    q = p.effects
    if not q:
        return ssr, None, None, None, n * math.log(p.sigma2), ssr / p.sigma2
    zr = np.stack([sy - a * n - b * st, sty - a * st - b * stt], 1)[:, :q]
    zz = np.stack([np.stack([n, st], 1), np.stack([st, stt], 1)], 1)[:, :q, :q]
    d = p.cov[k][:q, :q] + 1e-10 * np.eye(q)
    inner = np.linalg.inv(np.linalg.inv(d)[None] + zz / p.sigma2)
    mean = (inner @ zr[:, :, None])[:, :, 0] / p.sigma2
    logdet = n * math.log(p.sigma2) + np.linalg.slogdet(np.eye(q)[None] + zz @ d[None] / p.sigma2)[1]
    quad = (ssr - (zr * mean).sum(1)) / p.sigma2
    return ssr, zr, zz, (mean, inner), logdet, np.maximum(quad, 0.0)


def posteriors(s: np.ndarray, p: Parameters) -> tuple[np.ndarray, float]:
    """Class probabilities of each subject and the log-likelihood."""
    logs = np.empty((len(s), len(p.weight)))
    for k in range(len(p.weight)):
        *_, logdet, quad = _posterior_effects(s, p, k)
        logs[:, k] = math.log(max(p.weight[k], 1e-300)) - 0.5 * (s[:, 0] * math.log(2 * math.pi) + logdet + quad)
    top = logs.max(1, keepdims=True)
    e = np.exp(logs - top)
    total = e.sum(1, keepdims=True)
    return e / total, float((np.log(total) + top).sum())


def totals(s: np.ndarray, p: Parameters) -> np.ndarray:
    """What the next parameters need, summed over subjects: 11 numbers a class, then the log-likelihood."""
    r, loglik = posteriors(s, p)
    n, st, stt, sy, sty, syy = s.T
    out = np.zeros((len(p.weight), 11))
    for k in range(len(p.weight)):
        w = r[:, k]
        ssr, zr, zz, post, _, _ = _posterior_effects(s, p, k)
        ty, tty, rest, cov = sy, sty, ssr, np.zeros((2, 2))
        if p.effects:
            mean, inner = post
            q = p.effects
            full = np.zeros((len(s), 2))
            full[:, :q] = mean
            ty = sy - full[:, 0] * n - full[:, 1] * st
            tty = sty - full[:, 0] * st - full[:, 1] * stt
            second = inner + mean[:, :, None] * mean[:, None, :]
            cov[:q, :q] = (w[:, None, None] * second).sum(0)
            rest = ssr - 2 * (zr * mean).sum(1) + (zz * second).sum((1, 2))
        out[k] = [w.sum(), (w * n).sum(), (w * st).sum(), (w * stt).sum(), (w * ty).sum(), (w * tty).sum(), (w * rest).sum(), cov[0, 0], cov[0, 1], cov[1, 1], 0.0]
    return np.append(out.ravel(), loglik)


def next_parameters(total: np.ndarray, p: Parameters, diagonal: bool, shared: bool) -> Parameters:
    t = total[:-1].reshape(len(p.weight), 11)
    beta = p.beta.copy()
    for k, (_, n, st, stt, ty, tty, *_) in enumerate(t):
        det = n * stt - st * st
        if det > 1e-12 * max(1.0, n * stt):
            beta[k] = [(stt * ty - st * tty) / det, (n * tty - st * ty) / det]
    sigma2 = max(t[:, 6].sum() / max(t[:, 1].sum(), 1e-12), 1e-8)
    cov = np.zeros_like(p.cov)
    if p.effects:
        each = np.array([[[x[7], x[8]], [x[8], x[9]]] for x in t])
        cov[:] = each.sum(0) / max(t[:, 0].sum(), 1e-12) if shared else each / np.maximum(t[:, 0], 1e-12)[:, None, None]
        if diagonal:
            cov[:, 0, 1] = cov[:, 1, 0] = 0.0
    return Parameters(t[:, 0] / max(t[:, 0].sum(), 1e-12), beta, sigma2, cov, p.effects)


def _start(s: np.ndarray, k: int, effects: int, rng: np.random.Generator) -> Parameters:
    """Starting values from a k-means++ grouping of the subjects' own lines."""
    n, st, stt, sy, sty, syy = s.T
    level, det = sy / n, n * stt - st * st
    slope = np.where(det > 1e-9, (n * sty - st * sy) / np.where(det > 1e-9, det, 1), 0.0)
    own = np.stack([level, slope], 1)
    scale = own.std(0)
    z = own / np.where(scale > 0, scale, 1.0)
    centres = [z[rng.integers(len(z))]]
    for _ in range(k - 1):
        d = np.min([((z - c) ** 2).sum(1) for c in centres], 0)
        centres.append(z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))])
    c = np.array(centres)
    for _ in range(10):
        label = ((z[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([z[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    middle = own[label] - np.array([own[label == j].mean(0) if (label == j).any() else own[0] for j in range(k)])[label]
    c = c * np.where(scale > 0, scale, 1.0)
    beta = np.stack([c[:, 0] - c[:, 1] * (st.sum() / n.sum()), c[:, 1]], 1)
    fitted = syy - (sy**2) / n - np.where(det > 1e-9, slope**2 * det / n, 0.0)
    sigma2 = max(float(np.maximum(fitted, 0).sum() / max(n.sum() - 2 * len(s), 1)), 1e-3)
    cov = np.zeros((k, 2, 2))
    if effects:
        cov[:, 0, 0] = max(float(middle[:, 0].var()), 1e-3)
        if effects == 2:
            cov[:, 1, 1] = max(0.5 * float(middle[:, 1].var()), 1e-4)
    else:
        sigma2 += float(middle[:, 0].var())
    weight = np.bincount(label, minlength=k) + 1.0
    return Parameters(weight / weight.sum(), beta, sigma2, cov, effects)


def run(s: np.ndarray, p: Parameters, rounds: int, diagonal: bool, shared: bool, tolerance: float) -> tuple[Parameters, float, bool]:
    last = -np.inf
    for _ in range(rounds):
        total = totals(s, p)
        p = next_parameters(total, p, diagonal, shared)
        if total[-1] - last <= tolerance * (1 + abs(total[-1])):
            return p, total[-1], True
        last = total[-1]
    return p, last, False


@dataclass
class _Mixture:
    n_trajectories: int | None = 3
    random_state: int | None = 42
    n_init: int = 20
    max_iter: int = 200
    tolerance: float = 1e-7
    start_sample: int = 5000
    min_class_proportion: float = 0.03
    trajectory_names: Sequence[str] | None = None
    max_value_cols = 1
    effects = 0
    idiag = False
    nwg = False

    def __post_init__(self) -> None:
        if not self.n_trajectories or self.n_trajectories < 1 or self.n_init < 1 or self.max_iter < 1:
            raise InputValidationError("classes, starts and iterations must be positive")

    def fit(self, df: DataFrame, id_col: str, time_col: str, values: Sequence[str]) -> TrajectoryResult:
        """One outcome over a complete panel of at least two times."""
        if subject_series(df, id_col, time_col, values).filter(F.size("times") < 2).limit(1).count():
            raise InputValidationError("at least two times are needed")
        stats = cut(growth_statistics(df, id_col, time_col, values[0]))
        seed, k = self.random_state or 0, self.n_trajectories
        sample = np.array([[float(r[c]) for c in COLUMNS] for r in stats.orderBy(F.xxhash64("subject_id", F.lit(seed)), "subject_id").limit(self.start_sample).collect()])
        if len(sample) < k:
            raise InputValidationError("fewer subjects than classes")
        rng, shared = np.random.default_rng(seed), not self.nwg
        tried = [run(sample, _start(sample, k, self.effects, rng), min(self.max_iter, 50), self.idiag, shared, 1e-5) for _ in range(self.n_init if k > 1 else 1)]
        p, _, _ = max(tried, key=lambda x: x[1])
        n = stats.count()
        if n == len(sample):
            p, loglik, converged = run(sample, p, self.max_iter, self.idiag, shared, self.tolerance)
        else:
            p, loglik, converged = self._run_all(stats, p, shared)
        loglik = float(loglik)
        free = 3 * k - 1 + 1 + {0: 0, 1: 1, 2: 2 if self.idiag else 3}[self.effects] * (1 if shared else k)
        info = {"n_trajectories": k, "loglik": loglik, "AIC": 2 * free - 2 * loglik, "BIC": math.log(max(n, 1)) * free - 2 * loglik, "conv": int(converged), "n_parameters": free}
        return self._result(stats, df, time_col, p, info)

    def _run_all(self, stats: DataFrame, p: Parameters, shared: bool) -> tuple[Parameters, float, bool]:
        last, size = -np.inf, 11 * len(p.weight) + 1
        for _ in range(self.max_iter):

            def step(batches: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
                total = np.zeros(size)
                for pdf in batches:
                    if len(pdf):
                        total += totals(pdf[COLUMNS].to_numpy(float), p)
                yield pd.DataFrame({"x": [total]})

            rows = stats.select(*COLUMNS).mapInPandas(step, "x array<double>")
            total = np.array(rows.agg(F.array(*(F.sum(F.col("x")[i]) for i in range(size))).alias("x")).first()["x"])
            p = next_parameters(total, p, self.idiag, shared)
            if total[-1] - last <= self.tolerance * (1 + abs(total[-1])):
                return p, total[-1], True
            last = total[-1]
        return p, last, False

    def assign(self, df: DataFrame, id_col: str, time_col: str, values: Sequence[str], parameters: dict) -> TrajectoryResult:
        return self._result(growth_statistics(df, id_col, time_col, values[0]), df, time_col, Parameters.of(parameters), {})

    def _result(self, stats: DataFrame, df: DataFrame, time_col: str, p: Parameters, info: dict) -> TrajectoryResult:
        k = len(p.weight)
        names = trajectory_names(k, self.trajectory_names)

        @F.pandas_udf("array<double>")
        def classes(n: pd.Series, st: pd.Series, stt: pd.Series, sy: pd.Series, sty: pd.Series, syy: pd.Series) -> pd.Series:
            s = np.stack([x.to_numpy(float) for x in (n, st, stt, sy, sty, syy)], 1)
            return pd.Series(list(posteriors(s, p)[0]))

        probs = stats.select("subject_id", classes(*COLUMNS).alias("p"))
        label = F.array_position("p", F.array_max("p")) - 1
        named = probs.select("subject_id", label.cast("long").alias("trajectory_id"), *(F.col("p")[i].alias(f"class_{i}") for i in range(k)))
        name = F.get(F.array(*map(F.lit, names)), F.col("trajectory_id").cast("int"))
        out = named.select("subject_id", "trajectory_id", name.alias("trajectory_name"), *(f"class_{i}" for i in range(k)))
        times = [r[0] for r in df.select(F.col(time_col).try_cast("double").alias("t")).filter("t IS NOT NULL").distinct().orderBy("t").limit(100_001).collect()]
        if len(times) > 100_000:
            raise InputValidationError("at most 100000 different times can be listed; round the time column")
        lines = [{"trajectory_id": i, "time": t, "outcome": 0, "value": float(p.beta[i] @ [1.0, t])} for i in range(k) for t in times]
        return TrajectoryResult(out, lines, p.plain(), [info] if info else [])


@dataclass
class LatentClassGrowth(_Mixture):
    """Classes of straight lines with one residual variance and no random effects."""


@dataclass
class GrowthMixture(_Mixture):
    """Classes of straight lines whose subjects deviate by random intercepts, or intercepts and slopes.

    ``idiag``: the random effects are uncorrelated; ``nwg``: each class has its own covariance.
    """

    random_effects: str = "intercept"
    idiag: bool = False
    nwg: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.random_effects not in ("intercept", "intercept_slope"):
            raise InputValidationError("random_effects must be intercept or intercept_slope")
        self.effects = 1 if self.random_effects == "intercept" else 2
