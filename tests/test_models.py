"""Behaviour of runs on small random tables, and numeric identities of the fits."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F, types as T

import tabspark as ts
from tabspark.catalog import modelling
from tabspark.operators import cells, metrics, mlp, models, trees
from tabspark.plans import train as plan, tuning
from tabspark.plans.run import RunSpec
from tabspark.sources.runs import Runs

SMALL = {"random_forest": {"n_estimators": 8, "max_depth": 4},
         "gradient_boosting": {"n_estimators": 5, "max_depth": 3}, "linear": None}
SPACE = {"random_forest": {"n_estimators": (4, 8), "max_depth": (2, 4)},
         "gradient_boosting": {"n_estimators": (3, 5), "max_depth": (2, 3)}, "linear": {}}


# task detection

@pytest.mark.parametrize("values, kind, expected", [
    ([0, 1, 0, 1, 1], "int", "classification"), ([0, 1, 2, 0, 1, 2], "int", "classification"),
    ([1.0, 2.5, 3.7, 4.1], "double", "regression"), (range(100), "int", "regression"),
    (range(20), "int", "classification"), (range(21), "int", "regression")])
def test_task(spark, values, kind, expected):
    assert ts.detect_task(spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y") == expected


# classification

@pytest.fixture(scope="module")
def clf_run(clf_df):
    return ts.train(clf_df, "target", "random_forest", n_trials=2, space=SPACE["random_forest"])


def test_classification_metrics(clf_run):
    assert set(clf_run.metrics) == {"accuracy", "precision", "recall"}
    assert all(0 <= v <= 1 for v in clf_run.metrics.values())


def test_confusion_is_square(clf_run):
    assert clf_run.confusion.count() == 4 and clf_run.fitted.codec.classes == (0, 1)


def test_features_and_trials(clf_run):
    assert clf_run.fitted.spec.features == ("minutes", "spend", "channel", "member")
    assert clf_run.fitted.task == "classification" and len(clf_run.trials) == 2
    assert clf_run.best_params["max_features"] == "sqrt"


@pytest.mark.parametrize("model", ["gradient_boosting", "linear"])
def test_other_classifiers(clf_df, model):
    run = ts.train(clf_df, "target", model, n_trials=1, space=SPACE[model])
    assert 0 <= run.metrics["accuracy"] <= 1


@pytest.fixture(scope="module")
def small_ensemble():
    before = dict(models.ENSEMBLE)
    models.ENSEMBLE["random_forest"] = {"n_estimators": 5, "max_depth": 4}
    models.ENSEMBLE["gradient_boosting"] = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.1}
    yield
    models.ENSEMBLE.update(before)


def test_ensemble_classifier(clf_df, small_ensemble):
    run = ts.train(clf_df, "target", "ensemble")
    assert 0 <= run.metrics["accuracy"] <= 1 and run.trials == []
    assert ts.feature_importance(run.fitted).count() == 0
    row = run.fitted.predict(clf_df).first()
    assert sum(row.probability) == pytest.approx(1.0)
    check_additive_ensemble(run, clf_df)


def check_additive_ensemble(run, df):
    rows = df.withColumn("id", F.monotonically_increasing_id())
    parts = [ts.explain(run.fitted, rows, "id", member).filter("id = 0").orderBy("feature").collect()
             for member in ("random_forest", "gradient_boosting", "linear", None)]
    for each, mean in zip(zip(*parts[:3]), parts[3]):
        assert mean.contribution == pytest.approx(sum(r.contribution for r in each) / 3, abs=1e-9)
        assert mean.base_value == pytest.approx(sum(r.base_value for r in each) / 3, abs=1e-9)


def test_missing_target_rows_are_dropped(clf_df_with_nan):
    run = ts.train(clf_df_with_nan, "target", "random_forest", params=SMALL["random_forest"])
    assert run.dropped_rows == 30 and run.fitted.task == "classification"


def test_cross_validation(clf_df):
    run = ts.train(clf_df, "target", "random_forest", params=SMALL["random_forest"], cv=3)
    assert {"cv_accuracy_mean", "cv_accuracy_std"} <= set(run.metrics)
    scores = ts.cross_validate(clf_df, "target", "random_forest", SMALL["random_forest"], 3)
    assert scores.count() == 3


def test_learning_curve(clf_run, clf_df):
    curve = clf_run.learning_curve(clf_df).collect()
    sizes = [r.train_size for r in curve]
    assert len(curve) == 5 and sizes == sorted(sizes) and all(0 <= r.val_mean <= 1 and r.val_std >= 0 for r in curve)


# regression

@pytest.mark.parametrize("model", ["random_forest", "gradient_boosting", "linear"])
def test_regression_metrics(reg_df, model):
    run = ts.train(reg_df, "price", model, n_trials=1, space=SPACE[model])
    assert set(run.metrics) == {"r2", "mae", "rmse"} and run.metrics["rmse"] > 0 and run.metrics["mae"] > 0
    assert run.confusion is None and run.fitted.codec is None


def test_linear_is_ridge_on_regression(reg_df):
    run = ts.train(reg_df, "price", "linear", n_trials=2)
    assert isinstance(run.fitted.core, models.RidgeCore) and set(run.best_params) == {"alpha"}


def test_ensemble_regressor(reg_df, small_ensemble):
    run = ts.train(reg_df, "price", "ensemble")
    assert run.metrics["rmse"] > 0
    df = reg_df.withColumn("id", F.monotonically_increasing_id())
    assert_additive(run.fitted, df, F.col("prediction"))


def test_regression_cross_validation(reg_df):
    assert "cv_r2_mean" in ts.train(reg_df, "price", "linear", params={"alpha": 1.0}, cv=3).metrics


# contributions

def assert_additive(fitted, df, output):
    total = ts.explain(fitted, df, "id").groupBy("id").agg((F.sum("contribution") + F.first("base_value")).alias("t"))
    both = total.join(fitted.predict(df, ["id"]).select("id", output.alias("o")), "id")
    assert both.count() == df.count() and both.agg(F.max(F.abs(F.col("t") - F.col("o")) / (1 + F.abs("o")))).first()[0] < 1e-9


LAST = "element_at(probability, -1)"
MARGIN = "ln(element_at(probability, -1) / element_at(probability, 1))"


@pytest.mark.parametrize("model, target, output", [
    ("random_forest", "target", LAST), ("gradient_boosting", "target", f"{MARGIN} / 2"), ("linear", "target", MARGIN),
    ("random_forest", "price", "prediction"), ("gradient_boosting", "price", "prediction"),
    ("linear", "price", "prediction")])
def test_contributions_add_up(clf_df, reg_df, model, target, output):
    df = (clf_df if target == "target" else reg_df).withColumn("id", F.monotonically_increasing_id())
    fitted = ts.fit(df.drop("id"), target, model, SMALL[model])
    assert_additive(fitted, df, F.expr(output))
    names = {r.feature for r in ts.explain(fitted, df, "id").select("feature").distinct().collect()}
    assert names == set(fitted.spec.vector_names)


def test_tree_contributions_are_shapley_values(reg_df, monkeypatch):
    """Against the definition: all subsets of features, absent ones averaged by cover."""
    fitted = ts.fit(reg_df, "price", "random_forest", {"n_estimators": 3, "max_depth": 4})
    blocks = [r.asDict() for r in trees.leaf_blocks(reg_df.sparkSession, fitted.core.model, None, False).collect()]
    found = []
    for b in blocks:
        arrays = {c: np.frombuffer(b[c], k) for c, k in trees._KINDS.items()}
        found += zip(arrays["value"], *[arrays[c].reshape(b["leaves"], b["depth"]) for c in ("feature", "low", "high", "share")])
    x = np.array([r.x for r in fitted.prepared(reg_df).select(vector_to_array("features").alias("x")).limit(5).collect()])
    width = x.shape[1]

    def game(row, present):
        total = 0.0
        for value, *paths in found:
            share = 1.0
            for f, low, high, z in zip(*paths):
                share *= float(low < row[f] <= high) if f in present else z
            total += value * share
        return total

    def contributions(table_depth):
        monkeypatch.setattr(trees, "TABLE_DEPTH", table_depth)
        phi = np.zeros_like(x)
        for group in trees.groups(blocks):
            group.add(phi, x)
        return phi

    got = contributions(6)
    assert contributions(1) == pytest.approx(got, rel=1e-9)          # by integration instead of patterns
    for row, phi in zip(x, got):
        for i in range(width):
            others = [j for j in range(width) if j != i]
            expected = sum(
                math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width)
                * (game(row, {*s, i}) - game(row, set(s)))
                for k in range(width) for s in itertools.combinations(others, k))
            assert phi[i] == pytest.approx(expected, rel=1e-9, abs=1e-6)


def test_contributions_in_rounds(reg_df, monkeypatch):
    """A model that does not fit into one round gives the same sums."""
    df = reg_df.withColumn("id", F.monotonically_increasing_id())
    fitted = ts.fit(df.drop("id"), "price", "random_forest", {"n_estimators": 4, "max_depth": 5})
    whole = {(r.id, r.feature): r.contribution for r in ts.explain(fitted, df, "id").collect()}
    monkeypatch.setattr(trees, "ROUND_BYTES", 3000)
    monkeypatch.setattr(trees, "BLOCK_CELLS", 40)
    parts = {(r.id, r.feature): r.contribution for r in ts.explain(fitted, df, "id").collect()}
    assert len(whole) == 240 * 4 and parts == pytest.approx(whole, rel=1e-9, abs=1e-9)


def test_waterfall_and_global(reg_df):
    df = reg_df.withColumn("id", F.monotonically_increasing_id())
    fitted = ts.fit(df.drop("id"), "price", "linear", {"alpha": 1.0})
    contributions = ts.explain(fitted, df, "id")
    falls = ts.waterfall(fitted, df, "id", 2)
    assert "Exchange" not in falls._jdf.queryExecution().executedPlan().toString()
    twins = ts.waterfall(fitted, df.withColumn("id", F.lit(1)), "id", 2)        # rows with equal ids stay apart
    assert twins.filter("pos = 0").count() == 240
    one = falls.filter("id = 0").orderBy("pos").collect()
    assert [r.feature for r in one][0] == "(base)" and [r.feature for r in one][-2:] == ["(other)", "(total)"]
    assert abs(one[1].contribution) >= abs(one[2].contribution)
    assert one[-1].total == pytest.approx(fitted.predict(df, ["id"]).filter("id = 0").first().prediction)
    full = ts.waterfall(fitted, df, "id")        # fewer features than rows shown: no '(other)'
    assert full.filter("feature = '(other)'").count() == 0 and full.count() == 240 * 6
    assert ts.global_contributions(contributions).count() == 4


def test_importance(reg_df):
    top = ts.feature_importance(ts.fit(reg_df, "price", "random_forest", SMALL["random_forest"]), 2).collect()
    assert len(top) == 2 and {r.feature for r in top} <= {"beds", "surface", "storey", "quarter"}


# identities

@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [2.0, -1.0, 4.0] + 3 + rng.normal(size=400)
    rows = [(*map(float, r), float(v), int(v > 2) + int(v > 6)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, k int").persist(), x, y


@pytest.mark.parametrize("alpha", [0.0, 1.0, 30.0])
def test_ridge(signal, alpha, monkeypatch):
    df, x, y = signal
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    core = models.ridge_exact(df, ["a", "b", "c"], "y", alpha)
    assert core.coefficients == pytest.approx(expected, rel=1e-9)
    from tabspark.operators import gram
    monkeypatch.setattr(gram, "PAIR_LIMIT", 1)          # the wide path
    assert models.ridge_exact(df, ["a", "b", "c"], "y", alpha).coefficients == pytest.approx(expected, rel=1e-9)
    data = df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), F.col("y").alias("label"))
    spark_fit = LinearRegression(regParam=alpha * y.std(ddof=1) / 400, elasticNetParam=0, standardization=False,
                                 solver="l-bfgs", tol=1e-12, maxIter=500).fit(data)
    assert core.coefficients == pytest.approx(spark_fit.coefficients.toArray(), rel=1e-5)


def test_logistic(signal):
    df, x, _ = signal
    y = np.array([r.k > 0 for r in df.select("k").collect()], float)
    data = df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), (F.col("k") > 0).cast("double").alias("label"))
    core = models.fit_core(data, "linear", 2, {"C": 0.5})
    design, w = np.c_[x, np.ones(400)], np.zeros(4)
    penalty = np.diag([1, 1, 1, 0]) / 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design.T * (p * (1 - p))) @ design + penalty, design.T @ (p - y) + penalty @ w)
    assert core.coefficients[0] == pytest.approx(w[:3], rel=1e-7) and core.intercepts == pytest.approx([w[3]], rel=1e-7)


def test_logistic_path(signal, monkeypatch):
    """Three classes: several penalties at once, against separate fits and MLlib's search."""
    from tabspark.operators import newton
    df = signal[0]
    data = df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), F.col("k").cast("double").alias("label"))
    strengths = [0.05, 1.0, 50.0]
    cores = newton.fit_logistic(data, 3, strengths)
    one = models.fit_core(data, "linear", 3, {"C": 1.0})
    assert np.array(one.coefficients) == pytest.approx(np.array(cores[1].coefficients), abs=1e-8)
    scores = [r.p for r in cores[1].add_score(data, "p").collect()]
    assert all(len(p) == 3 and sum(p) == pytest.approx(1) for p in scores)
    monkeypatch.setattr(newton, "MOST_UNKNOWNS", 1)
    for c, core in zip(strengths, cores):
        wide = models.fit_core(data, "linear", 3, {"C": c}).model
        assert np.array(core.coefficients) == pytest.approx(wide.coefficientMatrix.toArray(), abs=2e-2 * max(1, c))
        assert sum(core.intercepts) == pytest.approx(0, abs=1e-8)
    # one class never seen, and none but one
    assert newton.fit_logistic(data.where("label < 2"), 3, [1.0])[0].add_score(data, "p").first().p[2] < 0.05


def test_softmax_boosting(signal, monkeypatch):
    """Against plain boosting in NumPy, with splits between all values and scores written anew on the way."""
    from tabspark.operators import boosting
    monkeypatch.setattr(boosting, "REFRESH", 2)
    df, x, _ = signal
    x = np.floor(x * 4) / 4
    y = np.array([r.k for r in df.select("k").collect()])
    rows = [(*map(float, r), int(k)) for r, k in zip(x, y)]
    told = df.sparkSession.createDataFrame(rows, "a double, b double, c double, k int").repartition(5)
    data = told.select(array_to_vector(F.array("a", "c")).alias("features"), F.col("k").cast("double").alias("label"))
    core = boosting.fit_softmax(data, 3, {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 2, "min_samples_leaf": 5}, 1)
    x = x[:, [0, 2]]
    raw = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))
    for _ in range(5):
        p = boosting.softmax(raw)
        for k in range(3):
            g = (y == k) - p[:, k]
            parts = [np.arange(len(y))]
            for _ in range(2):
                after = []
                for part in parts:
                    best = (0.0, None)
                    for f in range(2):
                        for v in np.unique(x[part, f])[:-1]:
                            left, right = part[x[part, f] <= v], part[x[part, f] > v]
                            if min(len(left), len(right)) >= 5:
                                gain = len(left) * len(right) * (g[left].mean() - g[right].mean()) ** 2
                                best = max(best, (gain, [left, right]), key=lambda b: b[0])
                    after += best[1] or [part]
                parts = after
            for part in parts:
                raw[part, k] += 0.3 * 2 / 3 * g[part].sum() / (np.abs(g[part]) * (1 - np.abs(g[part]))).sum()
    assert core.raw(x) == pytest.approx(raw, abs=1e-9)
    assert sum(core.importances(2)) == pytest.approx(1)
    again = boosting.SoftmaxCore.from_dict(core.as_dict())
    assert (again.raw(x) == core.raw(x)).all()


def test_models_find_the_signal(signal):
    """Well above the constant predictor, on some 80 test rows."""
    df = signal[0].select("a", "b", "c", "k")
    constant = df.groupBy("k").count().agg(F.max("count")).first()[0] / df.count()
    for model in ("random_forest", "gradient_boosting", "linear"):
        run = ts.train(df, "k", model, params=SMALL[model] or {})
        assert run.metrics["accuracy"] > constant + 0.25, model
        row = run.fitted.predict(df).first()
        assert len(row.probability) == 3 and sum(row.probability) == pytest.approx(1.0)


def test_ridge_trials_equal_separate_fits(signal):
    df = signal[0].select("a", "b", "c", "y")
    for cv in (None, 3):
        found = ts.tune(df, "y", "linear", 3, cv=cv)
        for entry in found.log:
            if cv:
                scores = ts.cross_validate(df, "y", "linear", entry["params"], cv)
                expected = scores.agg(F.avg("score")).first()[0]
            else:
                expected = ts.train(df, "y", "linear", params=entry["params"])
                expected = metrics.regression_metrics(expected.test_predictions, "y", digits=9).first()["r2"]
            assert entry["value"] == pytest.approx(expected, abs=1e-6)


def _gappy(spark, rows=300):
    """Gaps in numbers and categories, a category that small parts lack, and a constant column."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(rows):
        a, b = float(rng.normal(50, 9)), float(rng.gamma(2))
        c = "rare" if i % 97 == 0 else str(rng.choice(["x", "y", "z"]))
        y = 2 * a - 5 * b + 7 * (c == "y") + float(rng.normal())
        out.append((i, None if i % 7 == 0 else a, None if i % 11 == 0 else b, None if i % 13 == 0 else c, 4, y))
    return spark.createDataFrame(out, "id bigint, a double, b double, c string, same int, y double")


def test_cube_equals_separate_fits(spark, monkeypatch):
    """Curves, folds and trials from the cube, and from a preparation and a fit for each part."""
    df = _gappy(spark)
    args = {"key": ["id"], "exclude": ["id"]}

    def results():
        curve = ts.learning_curve(df, "y", "linear", {"alpha": 3.0}, **args).collect()
        folds = ts.cross_validate(df, "y", "linear", {"alpha": 0.5}, 4, **args).orderBy("fold").collect()
        trials = [ts.tune(df, "y", "linear", 3, cv=cv, tune_on=on, **args).log for cv, on in ((None, "holdout"), (3, "holdout"), (None, "validation"))]
        return ([v for r in curve for v in r[:-1]] + [r.score for r in folds] + [e["value"] for log in trials for e in log])

    from_cube = results()
    monkeypatch.setattr("tabspark.operators.cube.MOST_COLUMNS", 1)
    assert len(from_cube) == 5 * 5 + 4 + 9 and results() == pytest.approx(from_cube, abs=1e-8)


def _jobs(spark, group: str, call) -> int:
    """How many Spark jobs a call runs."""
    spark.sparkContext.setJobGroup(group, "")
    try:
        call()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_points_need_no_more_passes(spark):
    df = _gappy(spark).persist()
    few = _jobs(spark, "few", lambda: ts.learning_curve(df, "y", "linear", key=["id"], exclude=["id"], shares=(0.5, 1.0), folds=2))
    many = _jobs(spark, "many", lambda: ts.learning_curve(df, "y", "linear", key=["id"], exclude=["id"], shares=tuple(i / 10 for i in range(1, 11)), folds=5))
    assert few == many


def test_trial_log(spark, signal):
    found = ts.tune(signal[0].select("a", "b", "c", "y"), "y", "linear", 4, tune_on="validation")
    rows = found.trials(spark).orderBy("trial").collect()
    assert [r.best for r in rows] == [max(r.value for r in rows[:i + 1]) for i in range(4)]
    again = ts.tune(signal[0].select("a", "b", "c", "y"), "y", "linear", 4, tune_on="validation")
    assert again.log == found.log


def test_search_space():
    space = ts.search_space("random_forest", {"max_depth": (2, 4), "max_features": "log2"})
    assert space["max_depth"] == (2, 4) and space["n_estimators"] == (50, 300)
    for t in tuning.draw_trials("random_forest", space, 20, "classification"):
        assert 2 <= t["max_depth"] <= 4 and t["max_features"] == "log2" and isinstance(t["n_estimators"], int)
    with pytest.raises(ValueError):
        ts.search_space("linear", {"depth": 3})
    with pytest.raises(ValueError):
        ts.search_space("linear", {"C": (3, 1)})


# nets

@pytest.mark.parametrize("classes, norm", [(None, False), (None, True), (3, False), (3, True)])
def test_net_gradients(classes, norm):
    """Against finite differences, in training mode."""
    rng = np.random.default_rng(0)
    layers = mlp.init_layers([4, 6, 5, classes or 1], norm, 1)
    x, y = rng.normal(size=(12, 4)), rng.integers(0, 3, 12).astype(float)

    def loss():
        copy = mlp.unflatten(mlp.flatten(layers), layers)
        return mlp.loss_and_slope(mlp.forward(copy, x, 0.0, rng)[0], y, classes)[0] / 12

    out, tape = mlp.forward(mlp.unflatten(mlp.flatten(layers), layers), x, 0.0, rng)
    grads = mlp.gradients(layers, tape, mlp.loss_and_slope(out, y, classes)[1], 0.0)
    for i, layer in enumerate(layers):
        for k, g in grads[i].items():
            at = tuple(rng.integers(0, s) for s in layer[k].shape)
            old, h = layer[k][at], 1e-6
            layer[k][at] = old + h
            up = loss()
            layer[k][at] = old - h
            slope = (up - loss()) / (2 * h)
            layer[k][at] = old
            assert g[at] == pytest.approx(slope, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("model, target, params", [
    ("mlp", "k", {"hidden": (16,), "max_epochs": 50, "lr": 0.02}), ("mlp", "y", {"hidden": (16, 16), "max_epochs": 50, "lr": 0.02}),
    ("deep_mlp", "k", {"hidden": (32,), "max_epochs": 20, "lr": 0.03, "dropout": 0.1, "batch": 32}),
    ("deep_mlp", "y", {"hidden": (32,), "max_epochs": 30, "lr": 0.03, "dropout": 0.0, "batch": 32})])
def test_nets_learn(spark, signal, model, target, params):
    df = signal[0].select("a", "b", "c", target)
    run = ts.train(df, target, model, params=params)
    assert run.metrics["accuracy" if target == "k" else "r2"] > 0.7
    history = run.loss_history(spark)
    assert 0 < history.count() <= params["max_epochs"]
    first, last = history.orderBy("epoch").first(), history.agg(F.min("val_loss")).first()[0]
    assert last <= first.val_loss and metrics.best_epoch(history).count() == 1
    with pytest.raises(ValueError):
        ts.explain(run.fitted, df.withColumn("id", F.lit(1)), "id")


def test_net_merges_in_groups(signal, monkeypatch):
    """Adding up tasks in groups gives the weights that adding them up directly does."""
    data = signal[0].repartition(5, "a").select(array_to_vector(F.array("a", "b", "c")).alias("features"),
                                                F.col("y").alias("label")).persist()
    params = {"hidden": (16,), "max_epochs": 50, "lr": 0.05}
    direct = mlp.fit_net(data, "mlp", None, params)
    monkeypatch.setattr(mlp, "DIRECT_TASKS", 0)
    grouped = mlp.fit_net(data, "mlp", None, params)
    assert mlp.flatten(direct.layers) == pytest.approx(mlp.flatten(grouped.layers), rel=1e-6)


@pytest.mark.parametrize("norm", [False, True])
def test_steps_and_outputs_of_a_net(norm):
    """A step on one array is Adam's step on each, and outputs are those of the forward pass."""
    rng, p = np.random.default_rng(5), mlp.init_layers([4, 6, 5, 3], norm, 1)
    state = mlp.State.start(mlp.unflatten(mlp.flatten(p), p))
    m, v = ([{k: np.zeros_like(x) for k, x in layer.items()} for layer in p] for _ in range(2))
    for step in range(1, 4):
        grads = [{k: rng.normal(size=x.shape) for k, x in layer.items() if k in mlp.TRAINED} for layer in p]
        state.step(grads, 0.01)
        for layer, grad, a, b in zip(p, grads, m, v):
            for k, g in grad.items():
                a[k] += 0.1 * (g - a[k])
                b[k] += 0.001 * (g * g - b[k])
                layer[k] -= 0.01 * math.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * a[k] / (np.sqrt(b[k]) + 1e-8)
    assert (state.numbers() == mlp.State(p, m, v).numbers()).all()
    x = rng.normal(size=(40, 4))
    assert (mlp.outputs(p, x) == mlp.forward(p, x)[0]).all()
    again = state.like(state.numbers(), state.steps)       # what an epoch hands on takes steps of its own
    again.step(grads, 0.01)
    assert not (again.numbers() == state.numbers()).all() and again.steps == 4


def test_shards_grow_with_the_rows(signal, monkeypatch):
    """A task of a fit has a bounded number of rows, and the fit is still the same for any partitioning."""
    df = signal[0].select("a", "b", "c", "y")
    monkeypatch.setattr(models, "SHARD_ROWS", 50)
    with models.ready(df) as rows:
        held = [len(x) for x in rows.rdd.glom().collect()]
    assert sum(held) == df.count() and len(held) == -(-sum(held) // 50)
    params = {"n_estimators": 3, "max_depth": 3}
    fits = [plan.fit(d, "y", "random_forest", params) for d in (df.coalesce(1), df.repartition(7))]
    told = [sorted(r[0] for r in f.predict(df, ["a"]).select("prediction").collect()) for f in fits]
    assert told[0] == told[1]
    monkeypatch.setattr(models, "SHARD_ROWS", 10**9)
    with models.ready(df) as rows:
        assert rows.rdd.getNumPartitions() == 4            # the setting of the tests


def test_net_parameters_are_checked():
    for name, params in (("mlp", {"hidden": (8,)}), ("mlp", {"max_epochs": 10}), ("deep_mlp", {"dropout": 0.9}),
                         ("deep_mlp", {"hidden": (32, 32, 32, 32)}), ("mlp", {"depth": 3})):
        with pytest.raises(ValueError):
            mlp.check_params(name, params)


# saving, scoring, history

@pytest.mark.parametrize("model, target, params", [
    ("random_forest", "k", SMALL["random_forest"]), ("gradient_boosting", "k", SMALL["gradient_boosting"]),
    ("linear", "k", {}), ("linear", "y", {}), ("gradient_boosting", "y", SMALL["gradient_boosting"]),
    ("mlp", "k", {"hidden": (16,), "max_epochs": 50, "lr": 0.05})])
def test_save_and_load(spark, signal, tmp_path, model, target, params):
    df = signal[0].select("a", "b", "c", target).withColumn("id", F.monotonically_increasing_id())
    fitted = ts.fit(df.drop("id"), target, model, params)
    ts.save_model(spark, fitted, str(tmp_path / "m"))
    loaded = ts.load_model(spark, str(tmp_path / "m"))
    assert loaded.task == fitted.task and loaded.spec == fitted.spec and loaded.codec == fitted.codec
    before = sorted(map(tuple, fitted.predict(df, ["id"]).select("id", "prediction").collect()))
    assert before == sorted(map(tuple, loaded.predict(df, ["id"]).select("id", "prediction").collect()))


def test_save_ensemble_with_large_dictionary(spark, clf_df, tmp_path, small_ensemble, monkeypatch):
    from tabspark.operators import prep
    monkeypatch.setattr(prep, "LISTED_VALUES", 2)
    fitted = ts.fit(clf_df, "target", "ensemble")
    ts.save_model(spark, fitted, str(tmp_path / "m"))
    loaded = ts.load_model(spark, str(tmp_path / "m"))
    assert all(b["table"] is None or b["table"].startswith(str(tmp_path)) for b in loaded.prep.learned["categorical"]
               if b.get("table"))
    keep = ["minutes", "spend"]
    assert sorted(map(str, fitted.predict(clf_df, keep).collect())) == sorted(map(str, loaded.predict(clf_df, keep).collect()))


def test_scoring_checks_columns(spark, signal):
    df = signal[0]
    fitted = ts.fit(df.select("a", "b", "c", "k"), "k", "random_forest", SMALL["random_forest"])
    assert ts.score(fitted, df.select("a", F.lit("x").alias("other"))).count() == 400
    with pytest.raises(ValueError):
        ts.score(fitted, df.select(F.lit(1).alias("other")))
    proba = ts.score_proba(fitted, df.withColumn("id", F.monotonically_increasing_id()), "id")
    assert proba.count() == 1200 and {r["class"] for r in proba.select("class").distinct().collect()} == {0, 1, 2}


def test_stream_equals_batch(spark, signal, tmp_path):
    df = signal[0].withColumn("id", F.monotonically_increasing_id())
    fitted = ts.fit(df.select("a", "b", "c", "k"), "k", "random_forest", SMALL["random_forest"])
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ts.write_scores(ts.score_stream(fitted, stream, ["id"]), str(tmp_path / "out"), str(tmp_path / "ck"),
                    available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "prediction")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ts.score(fitted, df, ["id"]).select("id", "prediction").collect()))
    with pytest.raises(ValueError):
        ts.score_stream(fitted, df)


def test_string_target_with_many_values_is_refused(spark):
    df = spark.createDataFrame([(float(i), f"v{i}") for i in range(40)], "x double, y string")
    with pytest.raises(ValueError):
        ts.fit(df, "y", "linear")


def test_ignored_columns_are_reported(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(60)], "x double, y int").withColumn("at", F.current_timestamp())
    fitted = ts.fit(df, "y", "random_forest", SMALL["random_forest"])
    assert fitted.spec.ignored == ("at",) and fitted.spec.vector_names == ["x"]


def test_history_is_never_half_a_run(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    runs = [Runs(spark, str(tmp_path / "runs")) for _ in range(4)]
    assert runs[0].runs().count() == 0 and runs[0].metrics().count() == 0
    with ThreadPoolExecutor(4) as pool:          # appends at once from several handles
        ids = list(pool.map(lambda i: runs[i % 4].append("linear", "regression", "y", {"r2": i / 10, "mae": None}, started_at=f"{i}"), range(8)))
    assert {r.run_id: r.value for r in runs[0].metrics().collect()} == {ids[i]: i / 10 for i in range(8)}
    (tmp_path / "runs" / "log" / "broken" / "_temporary").mkdir(parents=True)     # an append that never ended
    assert runs[1].runs().count() == 8
    runs[1].clear()
    last = runs[2].append("linear", "regression", "y", {"r2": 0.5}, params={"alpha": 1})
    for _ in range(2):
        assert [r.run_id for r in runs[3].runs().collect()] == [last] and runs[3].detail(last)["params"] == {"alpha": 1}
        runs[3].append("linear", "regression", "z", {"r2": 0.1})
        runs[3].clear()
        last = runs[3].append("linear", "regression", "y", {"r2": 0.7}, params={"alpha": 1})
        runs[0].compact()
        runs[0].compact()
    with pytest.raises(KeyError):
        runs[0].detail(ids[0])


def test_history_and_replay(spark, signal, tmp_path):
    df = signal[0].select("a", "b", "c", "y")
    runs = ts.Runs(spark, str(tmp_path / "runs"))
    recipe = ts.Recipe().derive("ab", "a * b").clip_outliers(["c"])
    run = ts.train(df, "y", "linear", recipe, n_trials=2)
    other = ts.train(signal[0].select("a", "b", "c", "k"), "k", "random_forest", params=SMALL["random_forest"])
    first, _ = run.record(runs), other.record(runs)
    wide = runs.wide()
    assert wide.count() == 2 and {"r2", "accuracy"} <= set(wide.columns) and "params" not in wide.columns
    assert runs.compare("r2").count() == 1 and " | linear | y" in runs.compare("r2").first().run
    tables = runs.detail(runs.runs().filter("model = 'random_forest'").first().run_id)["tables"]
    assert {(r["actual"], r["predicted"]) for r in tables["confusion"]} == {(a, b) for a in range(3) for b in range(3)}
    kept = runs.detail(run.record(runs, run.learning_curve(df)))["tables"]["learning_curve"]
    assert [r["scoring"] for r in kept] == ["r2"] * 5
    runs.clear()
    first = run.record(runs)
    other.record(runs)
    wide = runs.wide()
    detail = runs.detail(first)
    assert detail["params"] == run.best_params and len(detail["steps"]) == 2 and detail["metrics"] == run.metrics
    again = RunSpec.from_json(run.replay_spec().to_json()).execute(df)
    assert again.metrics == run.metrics and "ab" in again.fitted.spec.features
    ts.write_csv(wide, str(tmp_path / "csv"))
    assert ts.read_csv(spark, str(tmp_path / "csv")).count() == 2
    runs.clear()
    assert runs.wide().count() == 0


def test_verdicts(spark):
    def curve(train, val, scoring="accuracy"):
        df = spark.createDataFrame([(10, 0.0, 9.0, scoring), (50, train, val, scoring)],
                                   "train_size int, train_mean double, val_mean double, scoring string")
        return metrics.diagnose_learning_curve(df).first().verdict

    assert [curve(0.9, 0.7), curve(0.55, 0.5), curve(0.9, 0.86), curve(0.9, 0.8)] == ["overfit", "underfit", "good", "moderate"]
    assert curve(0.55, 0.5, "r2") == "good"

    def loss(train, val, epochs, most):
        df = spark.createDataFrame([(epochs, train, val)], "epoch int, train_loss double, val_loss double")
        return metrics.diagnose_loss(df, most).first().verdict

    assert [loss(0.1, 0.9, 5, 9), loss(0.1, 0.9, 9, 9), loss(0.6, 0.7, 9, 9), loss(0.1, 0.2, 9, 9)] == [
        "early_stopped", "overfit", "underfit", "ok"]


# trees on cells

@pytest.fixture
def odd_rows(spark):
    rng = np.random.default_rng(11)
    x, few = rng.normal(size=3000), rng.integers(0, 5, 3000)
    y = 3 * np.abs(x) + few * (x > 0) + rng.normal(size=3000) / 5
    rows = [(i, float(a), float(b), "rare" if i % 500 == 0 else f"k{i % 3}", float(c), int(c > 3)) for i, (a, b, c) in enumerate(zip(x, few, y))]
    return spark.createDataFrame(rows, "id long, x double, few double, kind string, y double, label int").repartition(3)


@pytest.fixture
def on_cells(monkeypatch):
    def switch(on: bool):
        monkeypatch.setattr(cells, "CELL_ROWS", 1 if on else 10**12)
        monkeypatch.setattr(cells, "ROWS_A_CELL", 0)
    return switch


@pytest.mark.parametrize("target, other", [("y", "label"), ("label", "y")])
def test_boosting_on_cells_is_that_on_rows(odd_rows, on_cells, tmp_path, spark, target, other):
    told, data = [], odd_rows.drop(other)
    for on in (False, True):
        on_cells(on)
        fitted = ts.fit(data, target, "gradient_boosting", {"n_estimators": 6, "max_depth": 4}, exclude=("id",))
        out = F.col("probability")[1] if target == "label" else F.col("prediction")
        told.append(np.array([v for _, v in sorted(map(tuple, fitted.predict(data, ["id"]).select("id", out).collect()))]))
    assert told[0] == pytest.approx(told[1], abs=1e-6)
    ts.save_model(spark, fitted, str(tmp_path / "m"))
    again = ts.score(ts.load_model(spark, str(tmp_path / "m")), data, keep=["id"]).select("id", out)
    assert [v for _, v in sorted(map(tuple, again.collect()))] == pytest.approx(told[1].tolist())


@pytest.mark.parametrize("target, other", [("y", "label"), ("label", "y")])
def test_forest_on_cells(odd_rows, on_cells, spark, target, other):
    on_cells(True)
    params = {"n_estimators": 8, "max_depth": 5, "max_features": "all"}
    fits = [ts.fit(d, target, "random_forest", params, exclude=("id",)) for d in (odd_rows.drop(other).coalesce(1), odd_rows.drop(other).repartition(5))]
    assert fits[0].core.model.getNumTrees == 8 and len(set(fits[0].core.model.toDebugString.split("Tree ")[1:])) == 8
    out = F.col("probability")[1] if target == "label" else F.col("prediction")
    told = [[v for _, v in sorted(map(tuple, f.predict(odd_rows, ["id"]).select("id", out).collect()))] for f in fits]
    assert told[0] == told[1]
    on_cells(False)
    rows = ts.fit(odd_rows.drop(other), target, "random_forest", params, exclude=("id",))
    y = np.array([v for _, v in sorted(map(tuple, odd_rows.select("id", F.col(target).cast("double")).collect()))])
    errors = [float(((y - np.array([v for _, v in sorted(map(tuple, f.predict(odd_rows, ["id"]).select("id", out).collect()))])) ** 2).mean()) for f in (fits[0], rows)]
    assert errors[0] < 1.2 * errors[1] and errors[1] < 1.2 * errors[0]
    parts = ts.explain(fits[0], odd_rows, "id").groupBy("id").agg((F.sum("contribution") + F.first("base_value")).alias("v"))
    assert [v for _, v in sorted(map(tuple, parts.collect()))] == pytest.approx(told[0], abs=1e-6)


def test_cells_hold_all_rows_of_their_bins(odd_rows, on_cells, monkeypatch):
    on_cells(True)
    monkeypatch.setattr(cells, "DRAWN", 64)     # cells go on from one part of the rows to the next
    data = odd_rows.select(array_to_vector(F.array("few", (F.col("x") > 0).cast("double"))).alias("features"), F.col("y").alias("label")).persist()
    found, cuts = cells.cells(data, None, 64, lambda rows: 3, 20)
    got = {tuple(r["features"]): r for r in found.collect()}
    want = {(r["few"], float(r["up"])): r for r in odd_rows.groupBy("few", (F.col("x") > 0).alias("up")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()}
    assert [c.tolist() for c in cuts] == [[0.5, 1.5, 2.5, 3.5], [0.5]] and got.keys() == want.keys() and found.count() == 10
    for k, r in got.items():
        assert r["n"] == want[k]["n"] and r["total"] == pytest.approx(want[k]["y"])
    drawn = np.array([r["times"] for r in got.values()]).sum(0)
    assert len(drawn) == 20 and np.abs(drawn - 3000).max() < 300 and drawn.std() > 10
    means = np.array([np.array(r["sums"]) / np.array(r["times"]) - r["total"] / r["n"] for r in got.values()])
    assert 0 < np.abs(means).max() < 1                    # bags differ from their cell inside too
    assert cells.cells(data, None, 64, lambda rows: 3, cells.CELL_NUMBERS) is None
    monkeypatch.setattr(cells, "ROWS_A_CELL", 1000)
    assert cells.cells(data, None, 64, lambda rows: 3) is None
    data.unpersist()


def test_cut_points():
    assert cells.cut_points(np.array([3.0, 1.0, 1.0, 2.0]), 3).tolist() == [1.5, 2.5]
    assert cells.cut_points(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]
    assert cells.cut_points(np.array([7.0, 7.0]), 4).tolist() == []


# nets

def test_outputs_of_many_rows_stay_small():
    layers = mlp.init_layers([4, 32, 32, 1], True, 1)
    x = np.random.default_rng(1).normal(size=(50_000, 4))
    tracemalloc.start()
    try:
        out = mlp.outputs(layers, x)
        assert tracemalloc.get_traced_memory()[1] < 3e6       # one layer of all rows: 12.8 MB
    finally:
        tracemalloc.stop()
    assert out.shape == (50_000, 1) and out[[0, 1500, 49_999]] == pytest.approx(mlp.forward(layers, x[[0, 1500, 49_999]])[0])


def test_net_any_partitioning_joins_once(spark, tmp_path):
    spark.range(200).selectExpr("id AS c_custkey", "cast(id % 50 * 20 - 200 AS double) AS c_acctbal", "concat('s', id % 3) AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).selectExpr("id AS o_orderkey", "id % 200 AS o_custkey", "cast(id * 97 % 1000 * 300 AS double) AS o_totalprice",
                                "concat('p', id % 4) AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    told = modelling.net_any_partitioning(spark, str(tmp_path))
    assert not any("orders.parquet" in f for f in told.inputFiles())
    assert told.count() == 600 and told.filter("same").count() == 600
