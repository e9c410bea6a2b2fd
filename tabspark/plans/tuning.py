"""Search, cross-validation and learning curves. Every fit is a distributed job; several are
submitted at a time. Preparation is learned inside each training part, once per part, and
shared by all trials on it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tabspark.functions.columns import chunks
from tabspark.operators import metrics, models, newton, splits
from tabspark.operators.clean import drop_null_target
from tabspark.operators.cube import LinearCube, Part
from tabspark.operators.prep import FeatureSpec, LabelCodec, build_prep
from tabspark.operators.profile import detect_task
from tabspark.plans.train import keyed, labelled, target_codec

# Default search ranges (pairs are searched, single values are kept).
SEARCH = {
    "random_forest": {"n_estimators": (50, 300), "max_depth": (3, 15), "min_samples_leaf": (1, 5),
                      "min_samples_split": (2, 10), "max_features": "sqrt"},
    "gradient_boosting": {"n_estimators": (50, 300), "learning_rate": (0.01, 0.3), "max_depth": (3, 10),
                          "subsample": (0.7, 1.0), "min_samples_leaf": (1, 5)},
    "linear": {"C": (0.01, 20.0), "alpha": (0.01, 50.0)},
}
DEFAULT_TRIALS = 10
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)
DIGITS = 30                 # digits of a point that are shifted
CURVE_SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)
CURVE_FOLDS = 3
PARTS_AT_ONCE = 2           # prepared parts kept at a time; each may be as large as the table


def search_space(name: str, overrides: dict | None = None) -> dict:
    """Default ranges with the user's put over them, key by key."""
    space = {**SEARCH.get(name, {}), **(overrides or {})}
    unknown = set(space) - set(models.DEFAULTS.get(name, {}))
    if unknown:
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    for key, value in space.items():
        if isinstance(value, (tuple, list)) and (len(value) != 2 or value[0] > value[1]):
            raise ValueError(f"{key}: a range is (low, high), not {value}")
    return space


def halton(i: int, base: int, seed: int) -> float:
    """Point i of the sequence of a base, in 0..1: its digits mirrored at the point, each shifted by a seeded amount."""
    out, step = 0.0, 1.0
    for place in range(DIGITS):
        shift = int(hashlib.md5(f"halton|{seed}|{base}|{place}".encode()).hexdigest()[:8], 16)
        step /= base
        out += (i // base ** place + shift) % base * step
    return min(out, 1 - 1e-12)


def draw_trials(name: str, space: dict, n_trials: int, task: str, seed: int = 42) -> list[dict]:
    """``n_trials`` parameter sets of low discrepancy, a base for each range; whole-number ranges give whole numbers.

    Any first trials fill the space evenly, and more trials go on where fewer end.
    """
    if name == "linear":
        space = {k: v for k, v in space.items() if k == ("C" if task == "classification" else "alpha")}
    base = dict(zip([k for k, v in space.items() if isinstance(v, (tuple, list))], PRIMES))
    out = []
    for i in range(1, n_trials + 1):
        trial = {}
        for key, value in space.items():
            if not isinstance(value, (tuple, list)):
                trial[key] = value
                continue
            low, high = value
            point = halton(i, base[key], seed)
            whole = all(isinstance(v, int) for v in value)
            trial[key] = low + int(point * (high - low + 1)) if whole else low + point * (high - low)
        out.append(trial)
    return out


class _Part:
    """A prepared and persisted pair of training and validation rows."""

    def __init__(self, train: DataFrame, val: DataFrame, target: str, spec: FeatureSpec, codec: LabelCodec | None):
        prep = build_prep(spec).fit(train)
        with ExitStack() as opened:
            self.train, self.val = [opened.enter_context(models.ready(labelled(prep, side, target, codec)))
                                    for side in (train, val)]
            self._open = opened.pop_all()

    def close(self) -> None:
        self._open.close()


def _score(core, rows: DataFrame, is_class: bool) -> float | None:
    """Accuracy or R2 of a core on prepared rows; None without rows."""
    scored = core.add_score(rows, "_score")
    if is_class:
        return scored.agg(F.avg((models.argmax(F.col("_score")) == F.col("label")).cast("double"))).first()[0]
    return metrics.regression_metrics(scored, "label", "_score", digits=12).first()["r2"]


@dataclass
class TuneResult:
    best_params: dict
    best_value: float
    log: list[dict]         # one entry per trial

    def trials(self, spark) -> DataFrame:
        """(trial, params, value, best): the trial log with the best value so far."""
        rows = [(e["trial"], json.dumps(e["params"]), e["value"]) for e in self.log]
        return metrics.best_so_far(spark.createDataFrame(rows, "trial int, params string, value double"))


def with_folds(df: DataFrame, target: str, task: str, k: int, seed: int = 42,
               key: Sequence[str] | None = None) -> DataFrame:
    """``fold`` column: stratified for classification."""
    if task == "classification":
        return splits.stratified_kfold(df, k, target, seed, key)
    return splits.kfold(df, k, seed, key)


def _over_parts(df: DataFrame, spec: FeatureSpec, codec: LabelCodec | None, cv: int | None, seed: int,
                key: Sequence[str] | None, tune_on: str, calls: list[Callable]) -> list[list]:
    """Results of the calls on every prepared part: a list per part (fold, or the one split)."""
    target, task = spec.target, "classification" if codec else "regression"
    if cv:
        whole = with_folds(df, target, task, cv, seed, key).persist(StorageLevel.MEMORY_AND_DISK)
        sides = [(whole.filter(F.col("fold") != f), whole.filter(F.col("fold") == f)) for f in range(cv)]
    elif tune_on == "validation":
        whole = splits.three_way(df, seed, key)
        sides = [(whole.filter("part = 'train'"), whole.filter("part = 'val'"))]
    else:
        whole = splits.holdout(df, seed=seed, key=key)
        sides = [(whole.filter("not is_test"), whole.filter("is_test"))]
    out = []
    try:
        for some in chunks(sides, PARTS_AT_ONCE):
            with ExitStack() as opened:
                def prepare(side):
                    part = _Part(*side, target, spec, codec)
                    opened.callback(part.close)
                    return part

                parts = models.concurrently([lambda s=s: prepare(s) for s in some])
                out += chunks(models.concurrently([lambda p=p, c=c: c(p) for p in parts for c in calls]), len(calls))
    finally:
        if cv:
            whole.unpersist()
    return out


def part_means(scores: list[list]) -> list[float]:
    """Mean of each column over the parts; a part without rows to score has no say, but some part must have."""
    table = np.array(scores, dtype=float)
    some = ~np.isnan(table).all(axis=1)
    if not some.any():
        raise ValueError("no part has rows to score")
    return np.nanmean(table[some], axis=0).tolist()


def tune(df: DataFrame, target: str, name: str, n_trials: int = DEFAULT_TRIALS, cv: int | None = None,
         space: dict | None = None, seed: int = 42, key: Sequence[str] | None = None, task: str | None = None,
         tune_on: str = "holdout", exclude: Sequence[str] = ()) -> TuneResult:
    """Maximise accuracy or R2 over seeded trials, on the hold-out rows or as a fold mean.

    ``tune_on='validation'`` scores on a tenth that the final metrics never see.
    """
    df = drop_null_target(df, target)
    spec = FeatureSpec.from_df(df, target, exclude)
    df, key = keyed(df, spec, key)
    with models.ready(df) as rows:
        codec = target_codec(rows, target, task or detect_task(rows, target))
        return tune_rows(rows, spec, codec, name, n_trials, cv, space, seed, key, tune_on)


def tune_rows(df: DataFrame, spec: FeatureSpec, codec: LabelCodec | None, name: str, n_trials: int, cv: int | None,
              space: dict | None, seed: int, key: Sequence[str] | None, tune_on: str) -> TuneResult:
    """Tune on persisted rows that all have a target."""
    task = "classification" if codec else "regression"
    trials = draw_trials(name, search_space(name, space), n_trials, task, seed)
    classes = len(codec.classes) if codec else None
    scores = None
    if name == "linear" and codec is None:
        scores = _ridge_scores(df, spec, cv, seed, key, tune_on, [t["alpha"] for t in trials])
    elif name == "linear" and newton.fits(len(spec.vector_names), classes):
        strengths = [t["C"] for t in trials]
        scores = [path for [path] in _over_parts(df, spec, codec, cv, seed, key, tune_on, [lambda p: _logistic_path(p, classes, strengths)])]
    if scores is None:
        scores = _over_parts(df, spec, codec, cv, seed, key, tune_on, [
            lambda p, t=t: _score(models.fit_core(p.train, name, classes, t, seed), p.val, codec is not None)
            for t in trials])
    values = part_means(scores)
    log = [{"trial": i, "params": t, "value": v} for i, (t, v) in enumerate(zip(trials, values), 1)]
    best = max(log, key=lambda e: e["value"])
    return TuneResult(best["params"], best["value"], log)


def _linear_cube(df: DataFrame, spec: FeatureSpec, codec: LabelCodec | None, name: str, cell, cells: int) -> LinearCube | None:
    """The sums that all fits of a linear regression need, from a few passes; None for other models and very wide tables."""
    if name != "linear" or codec is not None:
        return None
    cube = LinearCube(df, spec, cell, cells)
    if cube.fits:
        cube.measure()
    return cube if cube.fits else None


def _fold_parts(k: int) -> list[Part]:
    return [Part([c for c in range(k) if c != f], [f]) for f in range(k)]


def _ridge_scores(df: DataFrame, spec: FeatureSpec, cv: int | None, seed: int, key: Sequence[str] | None, tune_on: str,
                  alphas: Sequence[float]) -> list[list[float]] | None:
    """Validation R2 of each part for every alpha, all from one cube."""
    if cv:
        rows, cell, parts = splits.kfold(df, cv, seed, key), F.col("fold"), _fold_parts(cv)
    elif tune_on == "validation":
        rows, parts = splits.three_way(df, seed, key), [Part([0], [1])]
        cell = F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1)
    else:
        rows, parts = splits.holdout(df, seed=seed, key=key), [Part([0], [1])]
        cell = F.col("is_test").cast("int")
    cube = _linear_cube(rows, spec, None, "linear", cell, cv or 2)
    return [p["val"] for p in cube.score(parts, alphas)] if cube else None


def _logistic_path(part: _Part, classes: int, strengths: list[float]) -> list[float]:
    """Validation accuracy for every C: the fits share their passes, and one more scores them all."""
    scored = part.val
    for i, core in enumerate(newton.fit_logistic(part.train, classes, strengths)):
        scored = core.add_score(scored, "_score").withColumn(f"_hit{i}", (models.argmax(F.col("_score")) == F.col("label")).cast("double")).drop("_score")
    got = scored.agg(*[F.avg(f"_hit{i}") for i in range(len(strengths))]).first()
    return [float("nan") if v is None else v for v in got]


def cross_validate(df: DataFrame, target: str, name: str, params: dict | None = None, k: int = 5, seed: int = 42,
                   key: Sequence[str] | None = None, task: str | None = None,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """(fold, score): accuracy or R2 of a fit on the other folds."""
    df = drop_null_target(df, target)
    task = task or detect_task(df, target)
    spec, codec = FeatureSpec.from_df(df, target, exclude), target_codec(df, target, task)
    df, key = keyed(df, spec, key)
    return cross_validate_rows(df, spec, codec, name, params, k, seed, key)


def cross_validate_rows(df: DataFrame, spec: FeatureSpec, codec: LabelCodec | None, name: str, params: dict | None,
                        k: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Cross-validate on rows that all have a target."""
    classes = len(codec.classes) if codec else None
    if name == "linear" and codec is None:
        alpha = float({**models.DEFAULTS["linear"], **(params or {})}["alpha"])
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scores = _ridge_scores(kept, spec, k, seed, key, "holdout", [alpha])
        finally:
            kept.unpersist()
        if scores is not None:
            return df.sparkSession.createDataFrame([(f, None if np.isnan(s) else s) for f, [s] in enumerate(scores)], "fold int, score double")
    scores = _over_parts(df, spec, codec, k, seed, key, "holdout", [
        lambda p: _score(models.fit_core(p.train, name, classes, params, seed), p.val, codec is not None)])
    return df.sparkSession.createDataFrame([(f, s) for f, [s] in enumerate(scores)], "fold int, score double")


def learning_curve(df: DataFrame, target: str, name: str, params: dict | None = None, seed: int = 42,
                   key: Sequence[str] | None = None, task: str | None = None,
                   shares: Sequence[float] = CURVE_SHARES, folds: int = CURVE_FOLDS,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """(train_size, train_mean, train_std, val_mean, val_std, scoring): growing nested parts of
    each fold's training rows. Empty when a part has no rows to fit or score."""
    df = drop_null_target(df, target)
    task = task or detect_task(df, target)
    spec, codec = FeatureSpec.from_df(df, target, exclude), target_codec(df, target, task)
    classes = len(codec.classes) if codec else None
    df, key = keyed(df, spec, key)
    marked = df.withColumn("_prefix", splits.prefix_bucket(df, seed, key))
    folded = with_folds(marked, target, task, folds, seed, key).persist(StorageLevel.MEMORY_AND_DISK)

    def cube_points() -> list[tuple] | None:
        """All points from one cube of (fold, step between shares)."""
        steps = sorted({round(share * splits.BUCKETS) for share in shares})
        step = sum(((F.col("_prefix") >= limit).cast("int") for limit in steps), F.lit(0))
        width = len(steps) + 1
        cube = _linear_cube(folded, spec, codec, name, F.col("fold") * width + step, folds * width)
        if cube is None:
            return None
        wanted = [(f, share) for share in shares for f in range(folds)]
        parts = [Part([o * width + i for o in range(folds) if o != f for i in range(steps.index(round(share * splits.BUCKETS)) + 1)],
                      [f * width + i for i in range(width)]) for f, share in wanted]
        alpha = float({**models.DEFAULTS["linear"], **(params or {})}["alpha"])
        known = lambda v: None if np.isnan(v) else v
        return [(share, p["n"], known(p["train"][0]), known(p["val"][0])) for (_, share), p in zip(wanted, cube.score(parts, [alpha]))]

    def point(fold: int, share: float) -> tuple:
        train = folded.filter((F.col("fold") != fold) & (F.col("_prefix") < round(share * splits.BUCKETS)))
        val = folded.filter(F.col("fold") == fold)
        part = _Part(train, val, target, spec, codec)
        try:
            n = part.train.count()
            if n == 0:
                return share, n, None, None
            core = models.fit_core(part.train, name, classes, params, seed)
            return share, n, _score(core, part.train, codec is not None), _score(core, part.val, codec is not None)
        finally:
            part.close()

    try:
        points = cube_points()
        if points is None:
            points = models.concurrently([lambda f=f, s=s: point(f, s) for s in shares for f in range(folds)])
    finally:
        folded.unpersist()
    spark = df.sparkSession
    schema = "share double, n long, train double, val double"
    if any(p[2] is None or p[3] is None for p in points):
        points = []
    scoring = "accuracy" if codec else "r2"
    return rollup_curve(spark.createDataFrame(points, schema), scoring)


def rollup_curve(points: DataFrame, scoring: str) -> DataFrame:
    """Mean and population std over the folds of each size."""
    return (points.groupBy("share").agg(
        F.round(F.avg("n")).cast("bigint").alias("train_size"),
        F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("val").alias("val_mean"), F.stddev_pop("val").alias("val_std"))
        .drop("share").withColumn("scoring", F.lit(scoring)).orderBy("train_size"))
