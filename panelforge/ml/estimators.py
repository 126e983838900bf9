"""Classifiers over feature columns.

Every fitted model adds ``prediction`` (double) and, if it can, ``probability`` (array<double>). Built-in Spark learners do the work
where they exist; what Spark lacks (nearest neighbours, recency-preferring trees) is fitted on at most ``max_rows`` rows
taken by a hash, the documented bound, and scores all rows in Arrow batches.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.core.errors import InputValidationError, OperationNotFoundError
from panelforge.functions.exprs import NUMERIC, not_nan, quoted
from panelforge.ml import trees
from panelforge.operators.encode import reduce_row
from panelforge.operators.impute import fill_values

MAX_CATEGORIES = 1000


@dataclass
class Preprocessor:
    """Numbers: median for missing; texts: mode for missing, then one column per category seen in fitting (others give 0)."""

    features: Sequence[str]
    fill: dict = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preprocessor:
        kinds = {c: df.schema[c].dataType for c in self.features}
        numbers = [c for c in self.features if isinstance(kinds[c], (*NUMERIC, T.BooleanType))]
        texts = [c for c in self.features if c not in numbers]
        plain = df.select(*(F.col(quoted(c)).cast("double" if c in numbers else "string").alias(c) for c in self.features))
        found = (fill_values(plain, numbers, "median_imputation") if numbers else {}) | (fill_values(plain, texts, "most_frequent_imputation") if texts else {})
        self.fill = {c: found.get(c, 0.0 if c in numbers else "") for c in [*numbers, *texts]}
        self.categories = {}
        for c in texts:
            seen = [r[0] for r in df.select(F.coalesce(F.col(quoted(c)).cast("string"), F.lit(self.fill[c])).alias("v")).distinct().orderBy("v").limit(MAX_CATEGORIES + 1).collect()]
            if len(seen) > MAX_CATEGORIES:
                raise InputValidationError(f"{c!r} has more than {MAX_CATEGORIES} categories; it is no class feature")
            self.categories[c] = seen
        return self

    def columns(self, features: Sequence[str] | None = None) -> list[tuple[str, Column]]:
        out = []
        for c in features or self.features:
            if c in self.categories:
                v = F.coalesce(F.col(quoted(c)).cast("string"), F.lit(self.fill[c]))
                out += [(f"{c}={x}", (v == x).cast("double")) for x in self.categories[c]]
            else:
                out.append((c, F.coalesce(not_nan(F.col(quoted(c)).cast("double")), F.lit(float(self.fill[c])))))
        return out


class Model:
    """``score(df)`` adds prediction and perhaps probability."""

    def __init__(self, score: Callable[[DataFrame], DataFrame], has_probability: bool, native=None):
        self.score, self.has_probability, self.native = score, has_probability, native


def _with_vector(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.array(*(c for _, c in columns))))


class SparkLearner:
    """A Spark classifier; ``binary_only`` ones go one-vs-rest for more classes and give no probabilities then."""

    def __init__(self, make: Callable, has_probability: bool = True, binary_only: bool = False):
        self.make, self.has_probability, self.binary_only = make, has_probability, binary_only

    def fit(self, df: DataFrame, columns: Sequence[tuple[str, Column]], label: str, n_classes: int, seed: int, **params) -> Model:
        learner = self.make(seed=seed, **params)
        learner.setFeaturesCol("__x").setLabelCol(label)
        many = self.binary_only and n_classes > 2
        if many:
            learner = OneVsRest(classifier=learner, featuresCol="__x", labelCol=label)
        fitted = learner.fit(_with_vector(df, columns).select("__x", F.col(label).cast("double").alias(label)))
        has = self.has_probability and not many

        def score(rows: DataFrame) -> DataFrame:
            out = fitted.transform(_with_vector(rows, columns))
            if has:
                out = out.withColumn("__p", vector_to_array("probability"))
            out = out.drop("__x", "rawPrediction", "probability")
            return out.withColumnRenamed("__p", "probability") if has else out

        return Model(score, has, fitted)


class ArrayLearner:
    """A numpy model: ``train(x, y, n_classes, seed, **context)`` returns an object whose ``predict(x)`` gives class scores."""

    has_probability = True

    def __init__(self, train: Callable, max_rows: int = 20_000):
        self.train, self.max_rows = train, max_rows

    def fit(self, df: DataFrame, columns: Sequence[tuple[str, Column]], label: str, n_classes: int, seed: int, **params) -> Model:
        x = F.array(*(c for _, c in columns))
        rows = df.select(x.alias("x"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("x", "y", F.lit(seed))).limit(self.max_rows).toPandas()
        model = self.train(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(int), n_classes, seed, **params)

        @F.pandas_udf("array<double>")
        def probability(v: pd.Series) -> pd.Series:
            return pd.Series(list(model.predict(np.array(v.tolist(), float)))) if len(v) else pd.Series([], dtype=object)

        def score(own: DataFrame) -> DataFrame:
            out = own.withColumn("probability", probability(x))
            return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

        return Model(score, True, model)


@dataclass
class _Neighbours:
    x: np.ndarray
    y: np.ndarray
    n_classes: int
    k: int
    mean: np.ndarray
    sd: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, t = (x - self.mean) / self.sd, (self.x - self.mean) / self.sd
        out = np.zeros((len(x), self.n_classes))
        k = min(self.k, len(t))
        for a in range(0, len(z), 256):
            d = (z[a : a + 256] ** 2).sum(1)[:, None] - 2 * z[a : a + 256] @ t.T + (t**2).sum(1)[None]
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            for c in range(self.n_classes):
                out[a : a + 256, c] = (self.y[near] == c).mean(1)
        return out


def _knn(x: np.ndarray, y: np.ndarray, n_classes: int, seed: int, n_neighbors: int = 5, **_) -> _Neighbours:
    sd = x.std(0)
    return _Neighbours(x, y, n_classes, int(n_neighbors), x.mean(0), np.where(sd > 0, sd, 1.0))


# Parameter names of the usual Python library on the left, Spark's on the right; max_depth None means Spark's deepest.
_NAMES = {"max_depth": "maxDepth", "n_estimators": "numTrees", "min_samples_leaf": "minInstancesPerNode", "max_iter": "maxIter", "learning_rate": "stepSize", "random_state": "seed", "max_bins": "maxBins", "subsample": "subsamplingRate"}


def _spark(cls, extra: dict | None = None, rename: dict | None = None):
    names = {**_NAMES, **(rename or {})}

    def make(seed: int, **params):
        given = dict(extra or {})
        for k, v in params.items():
            if k == "C":
                given["regParam"] = 1.0 / max(float(v), 1e-12) / 100
            else:
                given[names.get(k, k)] = v
        accepted = inspect.signature(cls.__init__).parameters
        unknown = [k for k in given if k not in accepted]
        if unknown:
            raise InputValidationError(f"{cls.__name__} takes no {', '.join(unknown)}")
        if "seed" in accepted:
            given.setdefault("seed", seed)
        return cls(**given)

    return make


STANDARD = {
    "decision_tree": SparkLearner(_spark(DecisionTreeClassifier)),
    "extra_trees": SparkLearner(_spark(RandomForestClassifier, {"bootstrap": False, "maxBins": 8, "numTrees": 60})),
    "gradient_boosting": SparkLearner(_spark(GBTClassifier, {"maxIter": 20}, {"n_estimators": "maxIter"}), binary_only=True),
    "knn": ArrayLearner(_knn),
    "logistic_regression": SparkLearner(_spark(LogisticRegression, {"regParam": 0.01})),
    "random_forest": SparkLearner(_spark(RandomForestClassifier, {"numTrees": 60})),
    "svm": SparkLearner(_spark(LinearSVC, {"regParam": 0.01}), has_probability=False, binary_only=True),
}
STRATEGIES = ("merwav_time_minus", "aggrfunc_mean", "aggrfunc_median", "sepwav_voting", "sepwav_stacking_lr", "sepwav_stacking_dt")
PLUS = ("lexico_decision_tree", "lexico_random_forest", "lexico_gradient_boosting", "lexico_deep_forest", "nested_trees")
LONGITUDINAL = tuple(f"{s}__{b}" for s in STRATEGIES for b in sorted(STANDARD)) + tuple(f"merwav_time_plus__{p}" for p in PLUS)


def standard_estimator(key: str):
    if key not in STANDARD:
        raise OperationNotFoundError(f"no estimator {key!r}; there are {', '.join(sorted(STANDARD))}")
    return STANDARD[key]


def parameters_of(key: str) -> list[str]:
    """Names that an estimator takes as hyperparameters."""
    learner = STANDARD.get(key)
    if isinstance(learner, ArrayLearner):
        return ["n_neighbors"]
    cls = {"decision_tree": DecisionTreeClassifier, "extra_trees": RandomForestClassifier, "random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier, "logistic_regression": LogisticRegression, "svm": LinearSVC}.get(key)
    return sorted(p for p in inspect.signature(cls.__init__).parameters if p not in ("self", "featuresCol", "labelCol")) if cls else []


@dataclass
class FeatureGroups:
    """Columns of each longitudinal feature by wave (None where it has none), and static columns."""

    groups: list[list[str | None]]
    static: list[str]

    @property
    def waves(self) -> int:
        return max(len(g) for g in self.groups)

    @property
    def features(self) -> list[str]:
        return [c for g in self.groups for c in g if c] + self.static


def fit_standard(df: DataFrame, features: Sequence[str], label: str, n_classes: int, key: str, seed: int, params: dict | None = None) -> Model:
    pre = Preprocessor(features).fit(df)
    return standard_estimator(key).fit(df, pre.columns(), label, n_classes, seed, **(params or {}))


def fit_longitudinal(df: DataFrame, groups: FeatureGroups, label: str, n_classes: int, key: str, seed: int, params: dict | None = None) -> Model:
    """A strategy over the waves with a base learner: flattened, aggregated per feature, one model a wave (vote or stack), or
    recency-preferring trees."""
    if key not in LONGITUDINAL:
        raise OperationNotFoundError(f"no longitudinal estimator {key!r}")
    strategy, base = key.split("__")
    params = params or {}
    if strategy == "merwav_time_minus":
        return fit_standard(df, groups.features, label, n_classes, base, seed, params)
    if strategy.startswith("aggrfunc"):
        how = strategy.split("_")[1]
        names = [f"__g{i}" for i in range(len(groups.groups))]

        def reduced(rows: DataFrame) -> DataFrame:
            return rows.select("*", *(reduce_row(rows, [c for c in g if c], how).alias(n) for n, g in zip(names, groups.groups)))

        inner = fit_standard(reduced(df), [*names, *groups.static], label, n_classes, base, seed, params)
        return Model(lambda rows: inner.score(reduced(rows)).drop(*names), inner.has_probability, inner.native)
    if strategy.startswith("sepwav"):
        return _per_wave(df, groups, label, n_classes, strategy, base, seed, params)
    recency = [w for g in groups.groups for w, c in enumerate(g) if c]
    pre = Preprocessor(groups.features).fit(df)
    columns = pre.columns()
    wave_of = {c: w for (c, w) in zip([c for g in groups.groups for c in g if c], recency)}
    of = [wave_of.get(name.split("=")[0], -1) for name, _ in columns]
    at = {name: i for i, (name, _) in enumerate(columns)}
    index = [[at[c] for c in g if c and c in at] for g in groups.groups]
    makers = {
        "lexico_decision_tree": lambda x, y, k, s, **p: trees.LexicoTree(k, of, seed=s, **p).fit(x, y),
        "lexico_random_forest": lambda x, y, k, s, **p: trees.fit_forest(x, y, k, of, seed=s, **p),
        "lexico_gradient_boosting": lambda x, y, k, s, **p: trees.fit_boosted(x, y, k, of, seed=s, **p),
        "lexico_deep_forest": lambda x, y, k, s, **p: trees.fit_deep(x, y, k, of, seed=s, **p),
        "nested_trees": lambda x, y, k, s, **p: trees.fit_nested(x, y, k, of, [g for g in index if g], seed=s, **p),
    }
    return ArrayLearner(makers[base]).fit(df, columns, label, n_classes, seed, **params)


def _per_wave(df: DataFrame, groups: FeatureGroups, label: str, n_classes: int, strategy: str, base: str, seed: int, params: dict) -> Model:
    waves = [[g[w] for g in groups.groups if w < len(g) and g[w]] + groups.static for w in range(groups.waves)]
    waves = [w for w in waves if w]

    def vectors(models: list[Model], rows: DataFrame) -> DataFrame:
        """Each wave's class scores (or its vote as 0/1) in columns ``__w{i}``."""
        for i, m in enumerate(models):
            rows = m.score(rows)
            vote = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: (c == F.col("prediction").cast("int")).cast("double"))
            rows = rows.withColumn(f"__w{i}", F.col("probability") if m.has_probability and strategy != "sepwav_voting" else vote).drop("prediction", "probability")
        return rows

    fit_all = lambda rows: [fit_standard(rows, w, label, n_classes, base, seed, params) for w in waves]
    models = fit_all(df)
    names = [f"__w{i}" for i in range(len(waves))]
    if strategy == "sepwav_voting":

        def vote(rows: DataFrame) -> DataFrame:
            out = vectors(models, rows)
            total = F.array(*(sum((F.col(n)[c] for n in names[1:]), F.col(names[0])[c]) / len(names) for c in range(n_classes)))
            out = out.withColumn("probability", total).drop(*names)
            return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

        return Model(vote, True)
    # stacking: the meta learner sees scores of models that were not fitted on the row
    part = F.pmod(F.xxhash64(*(F.col(quoted(c)) for c in groups.features), F.lit(seed)), F.lit(2))
    halves = df.withColumn("__half", part)
    out_of_sample = None
    for h in (0, 1):
        scored = vectors(fit_all(halves.filter(F.col("__half") != h)), halves.filter(F.col("__half") == h))
        out_of_sample = scored if out_of_sample is None else out_of_sample.unionByName(scored)
    columns = [(f"{n}_{c}", F.col(n)[c]) for n in names for c in range(n_classes)]
    meta_key = "logistic_regression" if strategy.endswith("_lr") else "decision_tree"
    meta = STANDARD[meta_key].fit(out_of_sample, columns, label, n_classes, seed)
    return Model(lambda rows: meta.score(vectors(models, rows)).drop(*names), True, meta.native)
