"""Model fitting on MLlib, with the parameter names of the tabular world.

``fit_core`` takes a table with ``features`` (vector) and ``label`` (double) and returns a
core: an object that adds one score column, an array of class probabilities or a number.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.functions.columns import col
from tabspark.operators import cells, newton
from tabspark.operators.boosting import fit_softmax
from tabspark.operators.gram import moments
from tabspark.session import shared_dir

MAX_BINS = 64
MAX_DEPTH = 30              # MLlib's own limit
PARALLEL_FITS = 4

MODELS = ("random_forest", "gradient_boosting", "linear", "ensemble", "mlp", "deep_mlp")

# Defaults used without tuning, and the members of the voting ensemble.
DEFAULTS = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "min_samples_split": 2,
                      "max_features": "sqrt", "bootstrap": True},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0,
                          "min_samples_leaf": 1},
    "linear": {"C": 1.0, "alpha": 1.0, "max_iter": 1000},
}
ENSEMBLE = {
    "random_forest": {"n_estimators": 100, "max_depth": 7},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
    "linear": {"C": 1.0, "alpha": 1.0, "max_iter": 500},
}


def concurrently(calls: list, at_once: int = PARALLEL_FITS) -> list:
    """Run driver-side calls that each submit Spark jobs; results keep the order."""
    bound = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(bound(c)) for c in calls]]


FIT_SHARDS = 8              # default of the session setting tabspark.fit.shards
SHARD_ROWS = 500_000        # rows of a shard, about; larger tables have more shards than the setting says


def shards_of(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("tabspark.fit.shards", str(FIT_SHARDS))), -(-rows // SHARD_ROWS))


@contextmanager
def ready(data: DataFrame):
    """The rows persisted for passes to come, dealt by their hash to a number of shards that only their count decides.

    Bags and samples are drawn shard by shard, so a fit is the same whatever the machine, its cores or
    the partitions the rows arrive in. The number is the session setting ``tabspark.fit.shards``, or more where a shard
    would have over SHARD_ROWS rows: what one task reads and holds does not grow with the table.
    """
    shards = shards_of(data.sparkSession, data.count())
    cols = [col(f.name) for f in data.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = data.repartition(shards, F.xxhash64(*cols)) if cols else data.repartition(shards)
    dealt = dealt.sortWithinPartitions(F.xxhash64(*cols), F.hash(*cols)) if cols else dealt
    rows = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _padded(probabilities: Column, classes: int) -> Column:
    """A training part may lack the last classes; they get probability 0."""
    gap = F.greatest(F.lit(0), F.lit(classes) - F.size(probabilities))
    return F.concat(probabilities, F.array_repeat(F.lit(0.0), gap))


def feature_array(df: DataFrame) -> Column:
    """The prepared features as an array, without going through a vector where possible."""
    return F.col("_x") if "_x" in df.columns else vector_to_array("features")


def dot(features: Column, weights: list[float]) -> Column:
    products = F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


@dataclass
class MllibCore:
    """One MLlib model; ``classes`` is None for regression."""
    model: object
    classes: int | None
    means: list[float] | None = None      # of the training features, for linear models

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        m = self.model
        if self.classes is None:
            return m.transform(df, {m.predictionCol: out})
        raw = m.transform(df, {m.probabilityCol: f"_v{out}", m.rawPredictionCol: "", m.predictionCol: ""})
        return raw.withColumn(out, _padded(vector_to_array(f"_v{out}"), self.classes)).drop(f"_v{out}")


@dataclass
class OneVsRestCore:
    """One boosted model per class; their probabilities are normalised to 1. Fits give a SoftmaxCore; this reads older saved models."""
    models: list
    classes: int

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        for i, m in enumerate(self.models):
            df = m.transform(df, {m.probabilityCol: f"_v{i}{out}", m.rawPredictionCol: "", m.predictionCol: ""})
        each = [vector_to_array(f"_v{i}{out}")[1] for i in range(self.classes)]
        df = df.withColumn(out, F.array(*each)).drop(*[f"_v{i}{out}" for i in range(self.classes)])
        total = F.aggregate(out, F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn(out, F.transform(out, lambda p: p / total))


@dataclass
class RidgeCore:
    """A linear regression known by its coefficients."""
    coefficients: list[float]
    intercept: float
    means: list[float]

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, dot(feature_array(df), self.coefficients) + F.lit(self.intercept))


@dataclass
class VoteCore:
    """Mean of the members' probabilities or predictions."""
    members: dict
    classes: int | None

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        names = []
        for name, member in self.members.items():
            names.append(f"_{name}_{out}")
            df = member.add_score(df, names[-1])
        return df.withColumn(out, vote([F.col(n) for n in names], self.classes)).drop(*names)


def vote(columns: list[Column], classes: int | None) -> Column:
    """Soft vote: element-wise mean of probability arrays, or the mean of numbers."""
    if classes is None:
        return sum(columns[1:], columns[0]) / F.lit(float(len(columns)))
    means = [sum([c[i] for c in columns[1:]], columns[0][i]) / F.lit(float(len(columns))) for i in range(classes)]
    return F.array(*means)


def argmax(probabilities: Column) -> Column:
    """Index of the largest probability; ties go to the smallest class."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def _subset(max_features: object) -> str:
    return {"sqrt": "sqrt", "log2": "log2", None: "all", 1.0: "all", "all": "all"}.get(max_features, str(max_features))


def _tree_args(p: dict) -> dict:
    # MLlib has no minimum size of a node to split: a node that splits has two children of at
    # least half of it, which is the nearest bound it can be given
    leaf = max(int(p.get("min_samples_leaf", 1)), math.ceil(int(p.get("min_samples_split", 2)) / 2))
    depth = int(p["max_depth"])
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be in 1..{MAX_DEPTH}")
    return {"maxDepth": depth, "minInstancesPerNode": leaf, "maxBins": MAX_BINS, "featuresCol": "features",
            "labelCol": "label"}


def fit_forest(data: DataFrame, classes: int | None, p: dict, seed: int) -> MllibCore:
    args = {**_tree_args(p), "numTrees": int(p["n_estimators"]), "seed": seed,
            "featureSubsetStrategy": _subset(p.get("max_features", "sqrt")), "bootstrap": bool(p.get("bootstrap", True))}
    est = RandomForestRegressor if classes is None else lambda **a: RandomForestClassifier(**a, impurity="gini")
    if args["bootstrap"] and args["minInstancesPerNode"] == 1:
        found = _cells(data, classes, args["numTrees"], seed)
        if found:
            return MllibCore(_forest_on_cells(*found, est, args, classes), classes)
    return MllibCore(est(**args).fit(data), classes)


def _cells(data: DataFrame, classes: int | None, trees: int, seed: int):
    return cells.cells(data, classes, MAX_BINS, lambda rows: shards_of(data.sparkSession, rows), trees, seed)


def _forest_on_cells(found: DataFrame, cuts: list[np.ndarray], est, args: dict, classes: int | None):
    """A fit for each tree, on the cells of its bag."""
    args = {**args, "numTrees": 1, "bootstrap": False, "maxBins": cells.BINS, "weightCol": "weight"}
    with ready(found) as kept:
        def tree(i: int):
            times = F.col("times")[i]
            label = F.col("label") if classes is not None else F.col("sums")[i] / times
            bag = kept.filter(times > 0).select("features", label.alias("label"), times.alias("weight"))
            return est(**{**args, "seed": args["seed"] + i}).fit(bag)

        fits = concurrently([lambda i=i: tree(i) for i in range(len(kept.first()["times"]))])
        return cells.with_cuts(found.sparkSession, cells.one_forest(fits, classes), cuts)


def fit_boosting(data: DataFrame, classes: int | None, p: dict, seed: int):
    shared_dir(data.sparkSession)         # boosting checkpoints there every ten trees
    args = {**_tree_args(p), "maxIter": int(p["n_estimators"]), "stepSize": float(p["learning_rate"]), "seed": seed,
            "subsamplingRate": float(p.get("subsample", 1.0))}
    if classes is not None and classes > 2:
        return fit_softmax(data, classes, p, seed)
    est = (lambda **a: GBTRegressor(**a, lossType="squared")) if classes is None else GBTClassifier
    if args["subsamplingRate"] == 1 and args["minInstancesPerNode"] == 1:
        found = _cells(data, classes, 0, seed)
        if found:
            with ready(found[0]) as kept:
                label = F.col("label") if classes is not None else F.col("total") / F.col("n")
                fitted = est(**{**args, "maxBins": cells.BINS}, weightCol="weight").fit(kept.select("features", label.alias("label"), F.col("n").alias("weight")))
                return MllibCore(cells.with_cuts(data.sparkSession, fitted, found[1]), classes)
    return MllibCore(est(**args).fit(data), classes)


def solve_ridge(n: int, means: np.ndarray, cov: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from the moments of (features..., target)."""
    p = len(means) - 1
    w = np.linalg.lstsq(n * cov[:p, :p] + alpha * np.eye(p), n * cov[:p, p], rcond=None)[0]
    return w, float(means[p] - w @ means[:p])


def feature_columns(data: DataFrame, width: int) -> DataFrame:
    """x0, x1, ... and y: the vector spread into columns for the aggregates."""
    x = data.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    return x.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)], "y")


def vector_width(data: DataFrame) -> int:
    first = data.select(F.size(vector_to_array("features"))).first()
    if first is None:
        raise ValueError("there are no rows to fit")
    return first[0]


def ridge_exact(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> RidgeCore:
    """Ridge regression in one pass: Spark sums the products, the driver solves a small system."""
    n, means, cov = moments(df, [*features, target])
    w, b = solve_ridge(n, means, cov, alpha)
    return RidgeCore([float(v) for v in w], b, [float(m) for m in means[:-1]])


def fit_linear(data: DataFrame, classes: int | None, p: dict, seed: int):
    """Logistic regression with penalty strength 1/C, or ridge with penalty alpha."""
    if classes is None:
        width = vector_width(data)
        return ridge_exact(feature_columns(data, width), [f"x{i}" for i in range(width)], "y", float(p["alpha"]))
    if newton.fits(vector_width(data), classes):
        return newton.fit_logistic(data, classes, [float(p["C"])], int(p.get("max_iter", 1000)))[0]
    n, means = data.agg(F.count(F.lit(1)), Summarizer.mean(F.col("features"))).first()
    est = LogisticRegression(regParam=1.0 / (float(p["C"]) * n), elasticNetParam=0.0, standardization=False,
                             maxIter=int(p.get("max_iter", 1000)), featuresCol="features", labelCol="label",
                             family="binomial" if classes <= 2 else "multinomial")
    return MllibCore(est.fit(data), classes, [float(m) for m in means])


def fit_ensemble(data: DataFrame, classes: int | None, p: dict, seed: int) -> VoteCore:
    names = list(ENSEMBLE)
    cores = concurrently([lambda n=n: FITTERS[n](data, classes, {**DEFAULTS[n], **ENSEMBLE[n]}, seed) for n in names])
    return VoteCore(dict(zip(names, cores)), classes)


FITTERS = {"random_forest": fit_forest, "gradient_boosting": fit_boosting, "linear": fit_linear,
           "ensemble": fit_ensemble}


def fit_core(data: DataFrame, name: str, classes: int | None, params: dict | None = None, seed: int = 42):
    if name in ("mlp", "deep_mlp"):
        from tabspark.operators.mlp import fit_net
        return fit_net(data, name, classes, params or {}, seed)
    if name not in FITTERS:
        raise ValueError(f"unknown model '{name}'; use one of {MODELS}")
    unknown = set(params or {}) - set(DEFAULTS.get(name, {}))
    if unknown:
        raise ValueError(f"unknown parameters for {name}: {sorted(unknown)}")
    return FITTERS[name](data, classes, {**DEFAULTS.get(name, {}), **(params or {})}, seed)
