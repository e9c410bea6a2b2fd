"""Boosted trees for three or more classes: one model, whose classes learn from a joint softmax.

A round adds a tree for each class, fitted to the gradients ``[y = k] - p_k`` of the log loss, with a Newton step in its
leaves. The trees of a round grow together, level by level; one pass over the rows gives the histograms of all classes and
nodes of a level; Spark adds them up and picks the splits, and the driver gets a line for each. Rows are packed once as blocks of bin numbers
beside their scores; the trees since the scores were last written are applied on the way.

Splits lie between the distinct values of a feature, or between MAX_BINS quantiles where it has more values than bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabspark.session import scratch_path

MAX_BINS = 64
#: Numbers of a packed block of rows, and rounds after which the scores are written anew.
PACKED_CELLS, REFRESH = 1 << 18, 4
TINY = 1e-150


@dataclass
class ClassTree:
    """A tree as arrays: a node's feature (-1: leaf), the last bin and value that go left, its left child (the right one follows),
    output, rows and gain."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def new(self) -> int:
        for name, start in (("feature", -1), ("bin", 0), ("cut", 0.0), ("left", -1), ("value", 0.0), ("rows", 0.0), ("gain", 0.0)):
            getattr(self, name).append(start)
        return len(self.feature) - 1

    def reach(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The node that each row ends in."""
        feature, left = np.array(self.feature), np.array(self.left)
        cut = np.array(self.bin if binned else self.cut)
        at = np.zeros(len(x), np.int64)
        while True:
            inside = np.flatnonzero(feature[at] >= 0)
            if not len(inside):
                return at
            node = at[inside]
            at[inside] = left[node] + (x[inside, feature[node]] > cut[node])


@dataclass
class SoftmaxCore:
    """Class probabilities from the sums of the classes' trees."""
    classes: int
    start: list[float]
    rate: float
    rounds: list[list[ClassTree]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * np.array(tree.value)[tree.reach(x, False)]
        return out

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        from tabspark.operators.models import feature_array
        core, classes = self, self.classes

        @F.arrow_udf("array<double>")
        def predict(x: pa.Array) -> pa.Array:
            ends = np.asarray(x.offsets)
            flat = x.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]] if len(x) else np.zeros(0)
            got = softmax(core.raw(flat.reshape(len(x), -1))) if len(x) else np.zeros((0, classes))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * classes, pa.int32()), pa.array(got.ravel(), pa.float64()))

        return df.withColumn(out, predict(feature_array(df)))

    def importances(self, width: int) -> list[float]:
        """Gains by feature, adding up to one."""
        total = np.zeros(width)
        for trees in self.rounds:
            for tree in trees:
                np.add.at(total, [f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain) if f >= 0])
        return (total / total.sum() if total.sum() else total).tolist()

    def leaves(self, k: int, factor: float = 1.0) -> list[tuple[float, dict]]:
        """The leaves of a class's trees, (value, {feature: (low, high, share)})."""
        out = []
        for trees in self.rounds:
            tree, stack = trees[k], [(0, {})]
            while stack:
                node, path = stack.pop()
                if tree.feature[node] < 0:
                    out.append((factor * self.rate * tree.value[node], path))
                    continue
                f, cut, left = tree.feature[node], tree.cut[node], tree.left[node]
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                stack.append((left, {**path, f: (low, min(high, cut), share * tree.rows[left] / tree.rows[node])}))
                stack.append((left + 1, {**path, f: (max(low, cut), high, share * tree.rows[left + 1] / tree.rows[node])}))
        return out

    def as_dict(self) -> dict:
        return {"classes": self.classes, "start": self.start, "rate": self.rate, "rounds": [[asdict(t) for t in r] for r in self.rounds]}

    @classmethod
    def from_dict(cls, about: dict) -> "SoftmaxCore":
        return cls(about["classes"], about["start"], about["rate"], [[ClassTree(**t) for t in r] for r in about["rounds"]])


def softmax(out: np.ndarray) -> np.ndarray:
    e = np.exp(out - out.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(column: pa.ListArray) -> np.ndarray:
    ends = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(len(column), -1)


def split_values(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each feature of (x array, ...) the values between which it may be split."""
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = [np.zeros(0)] * width, np.zeros(width, bool)
        for batch in batches:
            if batch.num_rows:
                x = _lists(batch.column("x"))
                for f in np.flatnonzero(~over):
                    held[f] = np.union1d(held[f], x[:, f])
                    over[f] = len(held[f]) > MAX_BINS
        names = [f for f in range(width) if not over[f] for _ in held[f]]
        values = [float(v) for f in range(width) if not over[f] for v in held[f]]
        full = np.flatnonzero(over).tolist()
        yield pa.record_batch([pa.array([*names, *full], pa.int32()), pa.array([*values, *[None] * len(full)], pa.float64())], names=["f", "value"])

    found = rows.select("x").mapInArrow(some, "f int, value double").distinct()
    # the values of a feature, unless some task or all of them together have more than there are bins
    few = found.groupBy("f").agg(F.bool_or(F.col("value").isNull()).alias("over"), F.count("value").alias("n"),
                                 F.slice(F.sort_array(F.collect_set("value")), 1, MAX_BINS).alias("held"))
    held = {r["f"]: r["held"] for r in few.where(~F.col("over") & (F.col("n") <= MAX_BINS)).select("f", "held").collect()}
    many = [f for f in range(width) if f not in held]
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    out: list[np.ndarray] = [np.zeros(0)] * width
    for f, values in held.items():
        out[f] = (np.array(values[1:]) + np.array(values[:-1])) / 2
    for at in range(0, len(many), 50):
        part = many[at:at + 50]
        row = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"f{f}") for f in part]).first()
        for f in part:
            out[f] = np.unique(np.array(row[f"f{f}"], float))
    return out


BLOCKS = "part long, block long, n int, bins binary, label binary, score binary"


def _pack(splits: list[np.ndarray], start: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _lists(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            bins = np.stack([np.searchsorted(s, x[:, f]) for f, s in enumerate(splits)], 1).astype(np.uint8)
            step = max(PACKED_CELLS // len(splits), 1)
            for at in range(0, len(x), step):
                n = len(x[at:at + step])
                yield pa.record_batch([
                    pa.array([batch.column("part")[0].as_py()], pa.int64()), pa.array([block], pa.int64()), pa.array([n], pa.int32()),
                    pa.array([bins[at:at + step].tobytes()], pa.binary()), pa.array([y[at:at + step].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([np.tile(np.array(start), (n, 1)).tobytes()], pa.binary())], names=["part", "block", "n", "bins", "label", "score"])
                block += 1
    return run


def _scores(x: np.ndarray, score: np.ndarray, rounds: list[list[ClassTree]], rate: float) -> np.ndarray:
    score = score.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            score[:, k] += rate * np.array(tree.value)[tree.reach(x, True)]
    return score


def _unpacked(batch: pa.RecordBatch, classes: int):
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        yield (batch.column("part")[i].as_py(), batch.column("block")[i].as_py(), np.frombuffer(batch.column("bins")[i].as_buffer(), np.uint8).reshape(n, -1),
               np.frombuffer(batch.column("label")[i].as_buffer(), np.int32), np.frombuffer(batch.column("score")[i].as_buffer()).reshape(n, classes))


HISTOGRAMS = "part long, k int, node int, sums binary"


def _level(shipped, classes: int, rate: float, share: float, seed: int):
    """For each class and open node of the trees that grow: rows, gradients and curvatures by feature and bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, growing, opened, number = shipped.value
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for part, block, x, label, score in _unpacked(batch, classes):
                if share < 1:
                    keep = np.random.default_rng([seed, number, part, block]).random(len(x)) < share
                    x, label, score = x[keep], label[keep], score[keep]
                p = softmax(_scores(x, score, rounds, rate)) if len(x) else np.zeros((0, classes))
                for k, nodes in enumerate(opened):
                    if not nodes or not len(x):
                        continue
                    at = growing[k].reach(x, True)
                    gradient = (label == k) - p[:, k]
                    curve = np.abs(gradient) * (1 - np.abs(gradient))
                    for node in nodes:
                        here = np.flatnonzero(at == node)
                        cell = (x[here] + np.arange(x.shape[1]) * MAX_BINS).ravel()
                        size = x.shape[1] * MAX_BINS
                        sums = np.stack([np.bincount(cell, np.repeat(w, x.shape[1]), size) for w in (
                            np.ones(len(here)), gradient[here], curve[here])])
                        total[part, k, node] = total.get((part, k, node), 0) + sums
        if total:
            keys = sorted(total)
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(zip(*keys), kinds)), pa.array([total[key].tobytes() for key in keys], pa.binary())], names=["part", "k", "node", "sums"])
    return run


SPLITS = "k int, node int, feature int, bin int, gain double, sums array<double>, low array<double>"


def _chosen(splits: list[np.ndarray], least: int):
    """The best split of a node, from the histograms of all tasks added up in order; only its sums leave Spark."""
    def run(table: pa.Table) -> pa.Table:
        cells = table["sums"].combine_chunks()
        total = None
        # in the order of the parts, so that the rounding is always the same
        for i in np.argsort(table["part"].to_numpy(), kind="stable").tolist():
            one = np.frombuffer(cells[i].as_buffer())
            total = one if total is None else total + one
        sums = total.reshape(3, len(splits), MAX_BINS)
        found = best_split(sums, splits, least)
        gain, f, b = found or (0.0, -1, 0)
        whole = sums[:, max(f, 0)].sum(1)
        low = sums[:, f, :b + 1].sum(1) if found else whole
        return pa.table({"k": table["k"].slice(0, 1), "node": table["node"].slice(0, 1), "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()),
                         "gain": pa.array([gain]), "sums": pa.array([whole.tolist()], pa.list_(pa.float64())), "low": pa.array([low.tolist()], pa.list_(pa.float64()))})
    return run


def best_split(sums: np.ndarray, splits: list[np.ndarray], least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node's histogram (3, features, bins); of equal gains the first."""
    n, g = sums[0], sums[1]
    left_n, left_g = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
    right_n, right_g = n.sum(1, keepdims=True) - left_n, g.sum(1, keepdims=True) - left_g
    ok = (left_n >= least) & (right_n >= least) & (np.arange(MAX_BINS - 1) < np.array([len(s) for s in splits])[:, None])
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (right_n * left_g - left_n * right_g) ** 2 / (left_n * right_n), -1.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    whole = float(n[0].sum())
    return (float(gain[f, b]) / whole, int(f), int(b)) if gain[f, b] > 1e-12 * whole else None


def fit_softmax(data: DataFrame, classes: int, p: dict, seed: int) -> SoftmaxCore:
    """Fit on ``features``/``label`` with labels 0..classes-1."""
    rows = data.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    counted = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counted:
        raise ValueError("there are no rows to fit")
    n = sum(counted.values())
    eps = float(np.finfo(np.float32).eps)
    start = [float(np.log(min(max(counted.get(k, 0) / n, eps), 1 - eps))) for k in range(classes)]
    splits = split_values(rows, rows.select(F.size("x")).first()[0])
    rate, depth, least, share = float(p["learning_rate"]), int(p["max_depth"]), int(p.get("min_samples_leaf", 1)), float(p.get("subsample", 1.0))
    spark = data.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boosting")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    blocks = written(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_pack(splits, start), BLOCKS))
    core, since = SoftmaxCore(classes, start, rate, []), 0
    for number in range(int(p["n_estimators"])):
        growing = [ClassTree() for _ in range(classes)]
        opened = [[tree.new()] for tree in growing]
        for _ in range(depth):
            shipped = spark.sparkContext.broadcast((core.rounds[since:], growing, opened, number))
            found = blocks.mapInArrow(_level(shipped, classes, rate, share, seed), HISTOGRAMS)
            found = found.groupBy("k", "node").applyInArrow(_chosen(splits, least), SPLITS)
            grown: list[list[int]] = [[] for _ in range(classes)]
            for row in sorted(found.collect(), key=lambda r: (r["k"], r["node"])):      # a row for each node of the level
                tree, node, whole, low = growing[row["k"]], row["node"], np.array(row["sums"]), np.array(row["low"])
                if node == 0:
                    tree.rows[0], tree.value[0] = float(whole[0]), _newton(whole, classes)
                f, b = row["feature"], row["bin"]
                if f < 0:
                    continue
                left = tree.new()
                tree.new()
                tree.feature[node], tree.bin[node], tree.cut[node], tree.left[node], tree.gain[node] = f, b, float(splits[f][b]), left, row["gain"]
                for child, part in ((left, low), (left + 1, whole - low)):
                    tree.rows[child], tree.value[child] = float(part[0]), _newton(part, classes)
                grown[row["k"]] += [left, left + 1]
            shipped.destroy()
            opened = grown
            if not any(opened):
                break
        core.rounds.append(growing)
        if len(core.rounds) - since >= REFRESH and number + 1 < int(p["n_estimators"]):
            blocks, since = written(_rescored(blocks, core.rounds[since:], classes, rate)), len(core.rounds)
    return core


def _newton(sums: np.ndarray, classes: int) -> float:
    return float((classes - 1) / classes * sums[1] / sums[2]) if abs(sums[2]) > TINY else 0.0


def _rescored(blocks: DataFrame, rounds: list[list[ClassTree]], classes: int, rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_scores(x, score, rounds, rate).tobytes() for _, _, x, _, score in _unpacked(batch, classes)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.binary())], names=batch.schema.names)
    return blocks.mapInArrow(run, BLOCKS)
