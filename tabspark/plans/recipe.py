"""The cleaning log: an ordered, serialisable list of steps that replays on a raw table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabspark.operators import clean
from tabspark.session import shared_dir
from tabspark.sources.runs import Runs

# The names of the steps, as saved logs have them.
OPS = ("drop_columns", "drop_sparse_columns", "clip_outliers", "fill_missing", "feature_engineering", "reset")
CHECKPOINT_EVERY = 10      # data-dependent steps after which the lineage is cut


@dataclass
class Recipe:
    """Steps in order. ``apply`` recomputes every statistic on the table it is given;
    ``fit`` returns a frozen recipe whose bounds and fill values are stored, so the same
    numbers are applied to new data.
    """
    steps: list[dict] = field(default_factory=list)

    def _add(self, op: str, **args) -> "Recipe":
        return Recipe([*self.steps, {"op": op, **args}])

    def drop_columns(self, columns: Sequence[str]) -> "Recipe":
        return self._add("drop_columns", columns=list(columns))

    def drop_sparse_columns(self, pct: float = 50) -> "Recipe":
        return self._add("drop_sparse_columns", pct=pct)

    def clip_outliers(self, columns: Sequence[str] | None = None, k: float = clean.IQR_K) -> "Recipe":
        return self._add("clip_outliers", columns=list(columns) if columns else None, iqr_mult=k)

    def fill_missing(self, methods: dict[str, str], constants: dict | None = None) -> "Recipe":
        return self._add("fill_missing", methods=dict(methods), constants=dict(constants or {}))

    def derive(self, name: str, formula: str) -> "Recipe":
        return self._add("feature_engineering", name=name, formula=formula)

    def drop_derived(self, name: str) -> "Recipe":
        """Remove a derived column; logged, so that a replay removes it too."""
        if name not in self.derived():
            raise ValueError(f"'{name}' is not a derived column")
        return self.drop_columns([name])

    def reset(self) -> "Recipe":
        return self._add("reset")

    def derived(self) -> list[str]:
        """Derived columns that the steps still leave in the table, as far as the log says."""
        names: list[str] = []
        for step in self.steps:
            match step["op"]:
                case "feature_engineering":
                    names = [n for n in names if n != step["name"]] + [step["name"]]
                case "drop_columns":
                    names = [n for n in names if n not in step["columns"]]
                case "reset":
                    names = []
        return names

    def _run(self, raw: DataFrame) -> tuple[DataFrame, list[dict]]:
        current, frozen, learned = raw, [], 0
        for step in self.steps:
            done = dict(step)
            match step["op"]:
                case "drop_columns":
                    current = clean.drop_columns(current, step["columns"])
                case "drop_sparse_columns":
                    columns = clean.sparse_columns(current, step["pct"])
                    done = {"op": "drop_columns", "columns": columns}
                    current = clean.drop_columns(current, columns)
                    learned += 1
                case "clip_outliers":
                    if "bounds" not in done:
                        columns = step["columns"] or clean.numeric_columns(current)
                        done["columns"] = columns
                        done["bounds"] = {c: list(b) for c, b in
                                          clean.iqr_bounds(current, columns, step["iqr_mult"]).items()}
                        learned += 1
                    current = clean.apply_clip(current, done["bounds"])
                case "fill_missing":
                    if "fills" not in done:
                        done["fills"] = clean.learn_fills(current, step["methods"], step["constants"])
                        learned += 1
                    current = clean.apply_fills(current, done["fills"])
                case "feature_engineering":
                    current = clean.derive(current, step["name"], step["formula"])
                case "reset":
                    current, learned = raw, 0
                case other:
                    raise ValueError(f"unknown step '{other}'; known: {OPS}")
            frozen.append(done)
            if learned == CHECKPOINT_EVERY:
                shared_dir(raw.sparkSession)
                current, learned = current.checkpoint(), 0
        return current, frozen

    def apply(self, raw: DataFrame) -> DataFrame:
        return self._run(raw)[0]

    def fit(self, raw: DataFrame) -> "Recipe":
        return Recipe(self._run(raw)[1])

    def to_json(self) -> str:
        return json.dumps(self.steps)

    @classmethod
    def from_json(cls, text: str) -> "Recipe":
        steps = json.loads(text)
        unknown = [s.get("op") for s in steps if s.get("op") not in OPS]
        if unknown:
            raise ValueError(f"unknown steps {unknown}; known: {OPS}")
        return cls(steps)


@dataclass
class Project:
    """A raw table, its recipe and the working table they give, and the history of the runs made in it.
    Loading new data starts a fresh recipe and keeps the history."""
    raw: DataFrame
    recipe: Recipe = field(default_factory=Recipe)
    runs: Runs | None = None

    @property
    def working(self) -> DataFrame:
        return self.recipe.apply(self.raw)

    def load(self, df: DataFrame) -> "Project":
        return Project(df, runs=self.runs)
