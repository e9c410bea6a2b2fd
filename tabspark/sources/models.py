"""Saving and loading a fitted preparation and model with its metadata."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession

from tabspark.operators import models
from tabspark.operators.boosting import SoftmaxCore
from tabspark.operators.mlp import NetCore, flatten, unflatten
from tabspark.operators.newton import LogisticCore
from tabspark.operators.prep import FeatureSpec, LabelCodec, TablePrepModel
from tabspark.plans.train import Fitted

_MLLIB = {c.__name__: c for c in (GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
                                  GBTRegressionModel, RandomForestRegressionModel)}


def _save_core(core, path: str) -> dict:
    match core:
        case models.MllibCore():
            core.model.write().overwrite().save(path)
            return {"kind": "mllib", "class": type(core.model).__name__, "classes": core.classes, "means": core.means}
        case models.OneVsRestCore():
            for i, m in enumerate(core.models):
                m.write().overwrite().save(f"{path}/{i}")
            return {"kind": "one_vs_rest", "classes": core.classes}
        case LogisticCore():
            return {"kind": "logistic", **asdict(core)}
        case SoftmaxCore():
            return {"kind": "softmax", **core.as_dict()}
        case models.RidgeCore():
            return {"kind": "ridge", **asdict(core)}
        case models.VoteCore():
            return {"kind": "vote", "classes": core.classes,
                    "members": {n: _save_core(m, f"{path}/{n}") for n, m in core.members.items()}}
        case NetCore():
            return {"kind": "net", "classes": core.classes, "scale": core.scale, "history": core.history,
                    "params": core.params, "weights": flatten(core.layers).tolist(),
                    "shapes": [{k: list(v.shape) for k, v in layer.items()} for layer in core.layers]}
    raise TypeError(f"cannot save {type(core).__name__}")


def _load_core(about: dict, path: str):
    import numpy as np
    match about["kind"]:
        case "mllib":
            return models.MllibCore(_MLLIB[about["class"]].load(path), about["classes"], about["means"])
        case "one_vs_rest":
            return models.OneVsRestCore([GBTClassificationModel.load(f"{path}/{i}") for i in range(about["classes"])],
                                        about["classes"])
        case "logistic":
            return LogisticCore(about["coefficients"], about["intercepts"], about["classes"], about["means"])
        case "softmax":
            return SoftmaxCore.from_dict(about)
        case "ridge":
            return models.RidgeCore(about["coefficients"], about["intercept"], about["means"])
        case "vote":
            return models.VoteCore({n: _load_core(a, f"{path}/{n}") for n, a in about["members"].items()},
                                   about["classes"])
        case "net":
            like = [{k: np.zeros(s) for k, s in layer.items()} for layer in about["shapes"]]
            return NetCore(unflatten(np.array(about["weights"]), like), about["classes"], tuple(about["scale"]),
                           [tuple(h) for h in about["history"]], about["params"])
    raise ValueError(f"unknown model kind {about['kind']}")


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Everything under one folder: prep, model, dictionaries and a one-row metadata table.

    Each save writes a folder of its own and switches the metadata last, so a model can be saved over
    the path it was loaded from, and a broken save leaves the old model as it is.
    """
    root, version = path, uuid.uuid4().hex
    path = f"{root}/{version}"
    learned = fitted.prep.learned
    for book in learned["categorical"]:
        if book.get("table"):                    # a large dictionary is copied along
            spark.read.parquet(book["table"]).write.mode("overwrite").parquet(f"{path}/codes/{book['name']}")
            book["table"] = f"{path}/codes/{book['name']}"
    prep = TablePrepModel(state=json.dumps(learned))
    prep.write().overwrite().save(f"{path}/prep")
    about = {"name": fitted.name, "task": fitted.task, "spec": asdict(fitted.spec), "params": fitted.params,
             "version": version, "classes": list(fitted.codec.classes) if fitted.codec else None,
             "label_type": fitted.codec.dtype if fitted.codec else None, "core": _save_core(fitted.core, f"{path}/model")}
    row = [(fitted.task, list(fitted.spec.features), json.dumps(about["classes"]), json.dumps(about))]
    (spark.createDataFrame(row, "task string, features array<string>, class_labels string, about string")
     .coalesce(1).write.mode("overwrite").json(f"{root}/metadata"))


def load_model(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.json(f"{path}/metadata").first()["about"])
    path = f"{path}/{about['version']}"
    spec = FeatureSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["spec"].items()})
    codec = LabelCodec(tuple(about["classes"]), about["label_type"]) if about["classes"] is not None else None
    return Fitted(about["name"], about["task"], spec, TablePrepModel.load(f"{path}/prep"),
                  _load_core(about["core"], f"{path}/model"), codec, about["params"])
