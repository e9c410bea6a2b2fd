"""A whole run: tune, fit, evaluate; and its description, which can be executed again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabspark.functions.columns import half_even
from tabspark.operators import metrics as M, models, splits
from tabspark.operators.clean import drop_null_target, null_target_rows
from tabspark.operators.mlp import NetCore
from tabspark.operators.prep import FeatureSpec
from tabspark.operators.profile import detect_task
from tabspark.plans import tuning
from tabspark.plans.recipe import Recipe
from tabspark.plans.train import Fitted, fit_rows, keyed, target_codec
from tabspark.sources.runs import Runs

NETS = ("mlp", "deep_mlp")
LISTED_CLASSES = 100          # classes up to which a run's confusion is kept with it


@dataclass(frozen=True)
class RunSpec:
    """What is needed to execute a run again on the raw table."""
    target: str
    model: str = "random_forest"
    cv: int | None = None
    n_trials: int = tuning.DEFAULT_TRIALS
    space: dict | None = None
    params: dict | None = None        # given parameters skip the search
    seed: int = 42
    key: tuple[str, ...] | None = None
    task: str | None = None
    tune_on: str = "holdout"
    exclude: tuple[str, ...] = ()     # columns that are no features, such as row ids
    steps: tuple = ()                 # the cleaning recipe

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "RunSpec":
        given = json.loads(text)
        for name in ("key", "exclude", "steps"):
            given[name] = tuple(given[name]) if given[name] is not None else None
        if given["space"]:
            given["space"] = {k: tuple(v) if isinstance(v, list) else v for k, v in given["space"].items()}
        return cls(**given)

    def execute(self, raw: DataFrame) -> "Run":
        return _execute(self, Recipe(list(self.steps)).apply(raw))


@dataclass
class Run:
    spec: RunSpec
    fitted: Fitted
    metrics: dict[str, float]
    best_params: dict
    dropped_rows: int                                # rows without a target
    trials: list[dict] = field(default_factory=list)
    confusion: DataFrame | None = None
    test_predictions: DataFrame | None = None

    def record(self, runs: Runs, curve: DataFrame | None = None) -> str:
        """Append the run to a history, with its confusion (up to LISTED_CLASSES), its loss history and a learning curve if given."""
        s, tables = self.spec, {}
        if self.confusion is not None and self.fitted.classes <= LISTED_CLASSES:
            tables["confusion"] = [r.asDict() for r in self.confusion.orderBy("actual", "predicted").collect()]
        if isinstance(self.fitted.core, NetCore):
            tables["loss"] = [dict(zip(("epoch", "train_loss", "val_loss", "lr"), h)) for h in self.fitted.core.history]
        if curve is not None:
            tables["learning_curve"] = [r.asDict() for r in curve.collect()]        # a row a share
        return runs.append(self.fitted.name, self.fitted.task, s.target, self.metrics, s.cv, len(self.trials),
                           self.best_params, list(s.steps), tables=tables)

    def replay_spec(self) -> RunSpec:
        """The spec with the found parameters, so that a replay does not search again."""
        found = None if self.fitted.name == "ensemble" else self.best_params
        return RunSpec(**{**asdict(self.spec), "params": found, "task": self.fitted.task})

    def learning_curve(self, df: DataFrame) -> DataFrame:
        """Of this run's parameters on its cleaned table; ``df`` is the raw one."""
        s = self.spec
        df = Recipe(list(s.steps)).apply(df)
        return tuning.learning_curve(df, s.target, s.model, self.fitted.params, s.seed, s.key, self.fitted.task,
                                     exclude=s.exclude)

    def loss_history(self, spark) -> DataFrame:
        if not isinstance(self.fitted.core, NetCore):
            raise ValueError("only nets have a loss history")
        return self.fitted.core.history_table(spark)


def train(df: DataFrame, target: str, model: str = "random_forest", recipe: Recipe | None = None, **options) -> Run:
    """Tune on seeded trials, fit, and evaluate on the hold-out fifth.

    With ``cv`` the search and the reported mean and std use folds, the kept model is fitted
    on all rows, and the hold-out metrics come from a second fit on the training rows.
    """
    if model not in models.MODELS:
        raise ValueError(f"unknown model '{model}'; use one of {models.MODELS}")
    spec = RunSpec(target, model, steps=tuple(recipe.steps) if recipe else (), **options)
    return _execute(spec, recipe.apply(df) if recipe else df)


def _execute(s: RunSpec, df: DataFrame) -> Run:
    spec = FeatureSpec.from_df(df, s.target, s.exclude)
    df, key = keyed(df, spec, s.key)
    # a run reads its rows many times; what stands before them (joins, recipes) runs once
    with models.ready(df) as rows:
        return _run_on(s, spec, key, drop_null_target(rows, s.target), null_target_rows(rows, s.target))


def _run_on(s: RunSpec, spec: FeatureSpec, key: list[str], df: DataFrame, dropped: int) -> Run:
    task = s.task or detect_task(df, s.target)
    codec = target_codec(df, s.target, task)
    params, trials = s.params, []
    if s.model in (*NETS, "ensemble"):
        params = s.params or {}
    elif params is None:
        found = tuning.tune_rows(df, spec, codec, s.model, s.n_trials, s.cv, s.space, s.seed, key, s.tune_on)
        params, trials = found.best_params, found.log
    if s.model == "deep_mlp" or s.tune_on == "validation":
        parted = splits.three_way(df, s.seed, key)
        train_rows, test = parted.filter("part <> 'test'"), parted.filter("part = 'test'").drop("part")
        train_rows = (train_rows.withColumn("_is_val", F.col("part") == "val").drop("part") if s.model == "deep_mlp"
                      else train_rows.filter("part = 'train'").drop("part"))
    else:
        parted = splits.holdout(df, seed=s.seed, key=key)
        train_rows, test = parted.filter("not is_test").drop("is_test"), parted.filter("is_test").drop("is_test")
    measured = fit_rows(train_rows, spec, s.model, params, task, s.seed, codec)
    kept = fit_rows(df, spec, s.model, params, task, s.seed, codec) if s.cv else measured
    pred = measured.predict(test, [s.target])
    table = (M.classification_metrics if codec else M.regression_metrics)(pred, s.target)
    values = {r["metric"]: r["value"] for r in M.metrics_long(table).collect()}
    if s.cv:
        scores = tuning.cross_validate_rows(df, spec, codec, s.model, params, s.cv, s.seed, key)
        mean, std = M.rollup_scores(scores).select(half_even(F.col("mean"), 3), half_even(F.col("std"), 3)).first()
        name = "accuracy" if codec else "r2"
        values.update({f"cv_{name}_mean": mean, f"cv_{name}_std": std})
    confusion = M.confusion(pred, codec.classes, s.target) if codec else None
    return Run(s, kept, values, dict(params), dropped, trials, confusion, pred)
