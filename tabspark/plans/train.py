"""Train, score and explain: the table-level API."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabspark.functions.columns import col, half_even
from tabspark.functions.hashing import MISSING
from tabspark.operators import metrics, models, trees
from tabspark.operators.boosting import SoftmaxCore
from tabspark.operators.clean import drop_null_target
from tabspark.operators.mlp import NetCore
from tabspark.operators.newton import LogisticCore
from tabspark.operators.prep import FeatureSpec, LabelCodec, TablePrepModel, align, build_prep
from tabspark.operators.profile import detect_task

TOP_FEATURES = 15
TOP_CONTRIBUTIONS = 12


@dataclass
class Fitted:
    """A preparation and a model that belong together."""
    name: str
    task: str
    spec: FeatureSpec
    prep: TablePrepModel
    core: object
    codec: LabelCodec | None
    params: dict = field(default_factory=dict)

    @property
    def classes(self) -> int | None:
        return len(self.codec.classes) if self.codec else None

    def prepared(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Aligned rows with ``features``; ``keep`` are columns to carry along as _keep_*."""
        known = [c for c in self.spec.features if c in df.columns]
        if not known:
            raise ValueError(f"none of the model's features {list(self.spec.features)} is in the table")
        carried = df.select(*[col(k).alias(f"_keep_{k}") for k in keep], *[col(c) for c in known])
        aligned = align(carried, self.spec.features, self.spec.types, [f"_keep_{k}" for k in keep])
        return self.prep.transform(aligned)

    def with_prediction(self, prepared: DataFrame) -> DataFrame:
        """Adds ``prediction`` (and ``probability`` for classification) to prepared rows."""
        out = self.core.add_score(prepared, "_score")
        if self.codec is None:
            return out.withColumnRenamed("_score", "prediction")
        return (out.withColumn("prediction", self.codec.decode(models.argmax(F.col("_score"))))
                .withColumnRenamed("_score", "probability"))

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        scored = self.with_prediction(self.prepared(df, keep))
        extra = ["probability"] if self.codec else []
        return scored.select(*[F.col(f"`_keep_{k}`").alias(k) for k in keep], "prediction", *extra)


def fit(df: DataFrame, target: str, model: str = "random_forest", params: dict | None = None,
        task: str | None = None, seed: int = 42, codec: LabelCodec | None = None,
        exclude: Sequence[str] = ()) -> Fitted:
    """Fit one model with given parameters on all rows that have a target.

    'linear' is logistic regression for classification and ridge for regression.
    """
    df = drop_null_target(df, target)
    spec = FeatureSpec.from_df(df.drop("_is_val"), target, exclude)
    with models.ready(needed_columns(df, spec)) as rows:
        return fit_rows(rows, spec, model, params, task, seed, codec)


def needed_columns(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that a fit reads, in table order, before they are kept for several passes."""
    wanted = {*spec.numeric, *spec.categorical, spec.target, *keep, "_is_val", "_key"}
    return df.select([col(c) for c in df.columns if c in wanted])


def keyed(df: DataFrame, spec: FeatureSpec, key: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The needed columns and the key that splits hash; without a key, a hash of the whole row."""
    if key:
        return needed_columns(df, spec, key), list(key)
    whole = F.xxhash64(*[F.coalesce(col(c).cast("string"), F.lit(MISSING)) for c in df.columns])
    return needed_columns(df.withColumn("_key", whole), spec), ["_key"]


def fit_rows(df: DataFrame, spec: FeatureSpec, model: str, params: dict | None, task: str | None, seed: int,
             codec: LabelCodec | None) -> Fitted:
    """Fit on persisted rows that all have a target."""
    target = spec.target
    task = task or detect_task(df, target)
    codec = target_codec(df, target, task, codec)
    prep = build_prep(spec).fit(df)
    with models.ready(labelled(prep, df, target, codec)) as data:
        core = models.fit_core(data, model, len(codec.classes) if codec else None, params, seed)
    return Fitted(model, task, spec, prep, core, codec, dict(params or {}))


def target_codec(df: DataFrame, target: str, task: str, known: LabelCodec | None = None) -> LabelCodec | None:
    """The classes of a classification target; None for regression, which needs a number."""
    if task == "classification":
        return known or LabelCodec.fit(df, target)
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"'{target}' has too many distinct values for classes and is not a number")
    return None


def labelled(prep: TablePrepModel, df: DataFrame, target: str, codec: LabelCodec | None) -> DataFrame:
    """(features, label): what a fit reads, and nothing else of the table."""
    label = codec.encode(col(target)) if codec else col(target).cast("double")
    extra = ["_is_val"] if "_is_val" in df.columns else []
    return prep.transform(df).select("features", label.alias("label"), *extra)


def score(fitted: Fitted, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predict a table: extra columns are ignored, missing features imputed; a table with
    none of the features is an error."""
    return fitted.predict(df, keep)


def score_proba(fitted: Fitted, df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, class, probability): one row per row and class, to 4 digits."""
    if fitted.codec is None:
        raise ValueError("probabilities need a classification model")
    scored = fitted.predict(df, [row_id])
    classes = F.array(*[F.lit(c).cast(fitted.codec.dtype) for c in fitted.codec.classes])
    return (scored.select(col(row_id), F.posexplode("probability").alias("_i", "_p"))
            .select(col(row_id), F.element_at(classes, F.col("_i") + 1).alias("class"),
                    half_even(F.col("_p"), 4).alias("probability")))


def evaluate(fitted: Fitted, test: DataFrame) -> DataFrame:
    """One-row metrics table of a model on held-out rows."""
    target = fitted.spec.target
    pred = fitted.predict(drop_null_target(test, target), [target])
    if fitted.codec:
        return metrics.classification_metrics(pred, target)
    return metrics.regression_metrics(pred, target)


def headline(fitted: Fitted, test: DataFrame) -> float | None:
    """The score that tuning, folds and curves use, unrounded: accuracy or R2."""
    target = fitted.spec.target
    pred = fitted.predict(drop_null_target(test, target), [target])
    return headline_of(pred, target, fitted.codec is not None)


def headline_of(pred: DataFrame, target: str, is_class: bool) -> float | None:
    if is_class:
        return pred.agg(F.avg((col(target) == F.col("prediction")).cast("double"))).first()[0]
    return metrics.regression_metrics(pred, target, digits=12).first()["r2"]


def feature_importance(fitted: Fitted, k: int = TOP_FEATURES, class_index: int | None = None) -> DataFrame:
    """(feature, importance): the top k by impurity decrease or |coefficient|. Ensembles and
    nets have none. Multi-class coefficients are averaged in absolute value, unless
    ``class_index`` picks one class."""
    names, core = fitted.spec.vector_names, fitted.core
    if isinstance(core, models.RidgeCore):
        values = [abs(w) for w in core.coefficients]
    elif isinstance(core, models.OneVsRestCore):
        each = [m.featureImportances.toArray() for m in core.models]
        values = list(sum(each) / len(each))
    elif isinstance(core, LogisticCore):
        weights = abs(np.array(core.coefficients))
        values = list(weights.mean(axis=0) if class_index is None else weights[class_index])
    elif isinstance(core, SoftmaxCore):
        values = core.importances(len(names))
    elif isinstance(core, models.MllibCore) and hasattr(core.model, "featureImportances"):
        values = list(core.model.featureImportances.toArray())
    elif isinstance(core, models.MllibCore):
        weights = abs(core.model.coefficientMatrix.toArray())
        values = list(weights.mean(axis=0) if class_index is None else weights[class_index])
    else:
        values = []
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def _contributions(fitted: Fitted, df: DataFrame, row_id: str, member: str | None) -> tuple[DataFrame, float]:
    """(row_id, phi): each row's contributions as one array, and the base they start from."""
    prepared = fitted.prepared(df, [row_id]).withColumnRenamed(f"_keep_{row_id}", "_row")
    leaves, weights, means, base = _additive(df.sparkSession, fitted.core.members[member] if member else fitted.core,
                                             fitted.classes)
    if leaves is not None:
        blocks, expected = trees.kept(leaves)
        rows, base = trees.tree_contributions(prepared, blocks, "_row"), base + expected
    else:
        rows = prepared.select(F.col("_row").alias("row_id"), F.col("_x").alias("x"))
    parts = [F.col("phi")] if leaves is not None else []
    if weights is not None:
        pairs = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(m)).alias("m"))
                          for w, m in zip(weights, means)])
        parts.append(F.zip_with("x", pairs, lambda x, c: c["w"] * (x - c["m"])))
    phi = parts[0] if len(parts) == 1 else F.zip_with(*parts, lambda a, b: a + b)
    return rows.select(F.col("row_id").alias(row_id), phi.alias("_phi")), float(base)


def explain(fitted: Fitted, df: DataFrame, row_id: str, member: str | None = None) -> DataFrame:
    """Long (row_id, feature, contribution, base_value) for every row of a table.

    Contributions and base sum to the output: the prediction for regression, the last
    class's probability for forests, its margin for boosting and logistic regression. A
    voting ensemble is explained by the mean of its members' contributions, or by those of
    one ``member``.
    """
    rows, base = _contributions(fitted, df, row_id, member)
    names = F.array(*[F.lit(n) for n in fitted.spec.vector_names])
    return (rows.select(col(row_id), F.posexplode("_phi").alias("_i", "contribution"))
            .select(col(row_id), F.element_at(names, F.col("_i") + 1).alias("feature"), "contribution",
                    F.lit(base).alias("base_value")))


def _additive(spark: SparkSession, core, classes: int | None,
              factor: float = 1.0) -> tuple[DataFrame | None, np.ndarray | None, np.ndarray | None, float]:
    """A core as packed leaves plus a linear part (weights, background means) plus the base of all but the leaves."""
    if isinstance(core, models.VoteCore):
        parts = [_additive(spark, m, classes, factor / len(core.members)) for m in core.members.values()]
        linear = [p for p in parts if p[1] is not None]        # an ensemble has one linear member
        blocks = [p[0] for p in parts if p[0] is not None]
        return (reduce(DataFrame.unionByName, blocks) if blocks else None, *(linear[0][1:3] if linear else (None, None)),
                sum(p[3] for p in parts))
    if isinstance(core, NetCore):
        raise ValueError("nets have no contributions")
    if isinstance(core, models.OneVsRestCore):
        return _additive(spark, models.MllibCore(core.models[-1], 2), 2, factor)
    if isinstance(core, SoftmaxCore):
        last = core.classes - 1
        return spark.createDataFrame(trees.packed(core.leaves(last, factor)), trees.PACKED), None, None, factor * core.start[last]
    if isinstance(core, models.RidgeCore):
        weights, means, intercept = np.array(core.coefficients), np.array(core.means), core.intercept
    elif isinstance(core, LogisticCore):
        weights, means, intercept = np.array(core.coefficients[-1]), np.array(core.means), core.intercepts[-1]
    elif hasattr(core.model, "coefficientMatrix"):
        weights, means = core.model.coefficientMatrix.toArray()[-1], np.array(core.means)
        intercept = float(core.model.interceptVector.toArray()[-1])
    else:
        boosted = type(core.model).__name__.startswith("GBT")
        return trees.leaf_blocks(spark, core.model, classes, boosted, factor), None, None, 0.0
    return None, factor * weights, means, factor * (intercept + float(weights @ means))


def waterfall(fitted: Fitted, df: DataFrame, row_id: str, n: int = TOP_CONTRIBUTIONS, member: str | None = None) -> DataFrame:
    """(row_id, pos, feature, contribution, total): base, top n by size, the rest as one
    '(other)' row, so that the running total ends at the model's output.

    All is done inside the row, so rows with equal ids stay apart and nothing is shuffled.
    """
    rows, base = _contributions(fitted, df, row_id, member)
    names = F.array(*[F.lit(x) for x in fitted.spec.vector_names])
    named = F.zip_with("_phi", names, lambda v, x: F.struct((-F.abs(v)).alias("size"), x.alias("feature"), v.alias("contribution")))
    ordered = F.transform(F.array_sort(named), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    rows = rows.withColumn("_o", ordered)
    other = F.aggregate(F.slice("_o", n + 1, F.greatest(F.size("_o") - n, F.lit(0))), F.lit(0.0), lambda a, x: a + x["contribution"])
    steps = F.concat(F.slice("_o", 1, n), F.when(F.size("_o") > n, F.array(F.struct(
        F.lit("(other)").alias("feature"), other.alias("contribution")))).otherwise(F.slice("_o", 1, 0)))
    rows = rows.withColumn("_s", steps)
    upto = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(base), lambda a, x: a + x["contribution"])
    step = F.transform("_s", lambda x, i: F.struct((i + 1).alias("pos"), x["feature"].alias("feature"),
                                                   x["contribution"].alias("contribution"), upto(i + 1).alias("total")))
    start = F.struct(F.lit(0).alias("pos"), F.lit("(base)").alias("feature"), F.lit(base).alias("contribution"), F.lit(base).alias("total"))
    whole = upto(F.size("_s"))
    end = F.struct(F.lit(n + 2).alias("pos"), F.lit("(total)").alias("feature"), whole.alias("contribution"), whole.alias("total"))
    return rows.select(col(row_id), F.inline(F.concat(F.array(start), step, F.array(end))))


def global_contributions(contributions: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute contribution over the table."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
