"""Multilayer perceptrons trained in parallel over the table's shards, with one optimiser from the first epoch to the last.

The rows of a fit are packed once into blocks of matrices. Each epoch is one Spark job: every task starts from the
broadcast state, takes Adam steps on mini-batches of its own rows, drawn from a shuffle buffer, and returns its state. The
state is more than weights: the optimiser's two moments and the buffers of batch norm belong to it, are averaged as the
weights are, by rows, and go on in the next epoch. Averages are taken in Spark, block by block of the state's numbers
and level by level, so the driver gets one state whatever the number of tasks. The pass that trains also measures the loss of the
weights it started from, so an epoch reads the data once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabspark.functions.hashing import bucket
from tabspark.operators.models import feature_array

# Defaults and allowed ranges of the two nets.
MLP = {"hidden": (128, 64), "lr": 1e-3, "max_epochs": 300, "batch": 200, "dropout": 0.0, "patience": 10,
       "batch_norm": False, "weight_decay": 1e-4}
DEEP_MLP = {"hidden": (256, 128, 64), "lr": 1e-3, "max_epochs": 100, "batch": 256, "dropout": 0.3, "patience": 10,
            "batch_norm": True, "weight_decay": 1e-4}
RANGES = {
    "mlp": {"hidden": (16, 512), "max_epochs": (50, 1000), "lr": (1e-4, 1e-1)},
    "deep_mlp": {"hidden": (32, 512), "max_epochs": (20, 500), "lr": (1e-4, 5e-2), "dropout": (0.0, 0.7),
                 "patience": (5, 50)},
}
FLAT_EPOCHS = 5        # epochs without improvement after which the deep net's learning rate halves
LEAST_GAIN = 1e-4      # what the validation score of the plain net has to gain to count as better
PACKED_CELLS = 1 << 18     # numbers of a packed block of rows
OUTPUT_CELLS = 1 << 15     # numbers of a layer that are computed together outside of training
BUFFER_CELLS = 1 << 22     # numbers of the rows that are shuffled together
STATE_BLOCK = 1 << 16      # numbers of a block of the state
DIRECT_TASKS = 32          # tasks whose states may come to the driver one by one, and fan-in of a level of averages
EPS = 1e-5


def check_params(name: str, params: dict) -> dict:
    base = MLP if name == "mlp" else DEEP_MLP
    unknown = set(params) - set(base)
    if unknown:
        raise ValueError(f"unknown parameters for {name}: {sorted(unknown)}")
    for key, (lo, hi) in RANGES[name].items():
        for v in np.atleast_1d(params.get(key, base[key])):
            if not lo <= v <= hi:
                raise ValueError(f"{key} must be in {lo}..{hi}, not {v}")
    p = {**base, **params}
    if len(p["hidden"]) > (2 if name == "mlp" else 3):
        raise ValueError("too many hidden layers")
    return p


def init_layers(sizes: list[int], batch_norm: bool, seed: int) -> list[dict]:
    rng = np.random.default_rng(seed)
    layers = []
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        bound = math.sqrt(6 / (a + b))
        layer = {"w": rng.uniform(-bound, bound, (a, b)), "b": rng.uniform(-bound, bound, b)}
        if batch_norm and i < len(sizes) - 2:
            layer |= {"gamma": np.ones(b), "beta": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b)}
        layers.append(layer)
    return layers


TRAINED = ("w", "b", "gamma", "beta")


def forward(layers: list[dict], x: np.ndarray, dropout: float = 0.0, rng=None) -> tuple[np.ndarray, list[dict]]:
    """Output and, in training (``rng`` given), what the backward pass needs."""
    tape = []
    for i, layer in enumerate(layers):
        step = {"x": x}
        x = x @ np.asfortranarray(layer["w"])          # for small matrices a third of the time
        x += layer["b"]
        if i < len(layers) - 1:
            if "gamma" in layer:
                if rng is not None and len(x) > 1:
                    mean = np.add.reduce(x, 0) / len(x)
                    apart = x - mean
                    var = np.add.reduce(apart * apart, 0) / len(x)
                    layer["mean"] = 0.9 * layer["mean"] + 0.1 * mean
                    layer["var"] = 0.9 * layer["var"] + 0.1 * var * len(x) / (len(x) - 1)
                    step["live"] = True
                else:
                    apart, var = x - layer["mean"], layer["var"]
                    step["live"] = False
                step["inv"] = 1 / np.sqrt(var + EPS)
                apart *= step["inv"]
                step["hat"] = apart
                x = layer["gamma"] * apart
                x += layer["beta"]
            live = x > 0
            if rng is not None and dropout > 0:
                live &= rng.random(x.shape) >= dropout
                step["mask"] = live * (1 / (1 - dropout))
            else:
                step["mask"] = live.astype(float)
            x *= step["mask"]
        tape.append(step)
    return x, tape


def outputs(layers: list[dict], x: np.ndarray) -> np.ndarray:
    """The output alone, outside of training, some rows after the others: what lies between the layers stays small."""
    step = max(OUTPUT_CELLS // max(layer["w"].shape[1] for layer in layers), 1)
    if len(x) > step:
        return np.concatenate([outputs(layers, x[at:at + step]) for at in range(0, len(x), step)])
    for i, layer in enumerate(layers):
        x = x @ np.asfortranarray(layer["w"])
        x += layer["b"]
        if i < len(layers) - 1:
            if "gamma" in layer:
                x -= layer["mean"]
                x *= 1 / np.sqrt(layer["var"] + EPS)
                x *= layer["gamma"]
                x += layer["beta"]
            np.maximum(x, 0, out=x)
    return x


def loss_and_slope(out: np.ndarray, y: np.ndarray, classes: int | None) -> tuple[float, np.ndarray]:
    """Summed loss (squared error, or cross entropy) and its slope per row."""
    if classes is None:
        d = out[:, 0] - y
        return float(d @ d), 2 * d[:, None]
    p = softmax(out)
    hit = y.astype(int), np.arange(len(y))
    loss = -np.log(np.maximum(p[hit[1], hit[0]], 1e-12)).sum()
    p[hit[1], hit[0]] -= 1
    return float(loss), p


def softmax(out: np.ndarray) -> np.ndarray:
    e = np.exp(out - out.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(layers: list[dict], tape: list[dict], slope: np.ndarray, decay: float) -> list[dict]:
    """Slopes of the mean loss, plus ``decay`` times the weights."""
    grads: list[dict] = [{} for _ in layers]
    g = slope / len(slope)
    for i in range(len(layers) - 1, -1, -1):
        layer, step = layers[i], tape[i]
        if i < len(layers) - 1:
            g *= step["mask"]
            if "gamma" in layer:
                grads[i]["gamma"], grads[i]["beta"] = (g * step["hat"]).sum(0), g.sum(0)
                g *= layer["gamma"]
                g *= step["inv"]
                if step["live"]:
                    mean, along = np.add.reduce(g, 0) / len(g), np.add.reduce(g * step["hat"], 0) / len(g)
                    g -= mean
                    g -= step["hat"] * along
        grads[i]["w"] = step["x"].T @ g + decay * layer["w"]
        grads[i]["b"] = g.sum(0)
        if i:
            g = g @ layer["w"].T
    return grads


def flatten(layers: list[dict]) -> np.ndarray:
    return np.concatenate([layer[k].ravel() for layer in layers for k in sorted(layer)])


def unflatten(flat: np.ndarray, like: list[dict]) -> list[dict]:
    out, at = [], 0
    for layer in like:
        new = {}
        for k in sorted(layer):
            size = layer[k].size
            new[k] = flat[at:at + size].reshape(layer[k].shape).copy()
            at += size
        out.append(new)
    return out


@dataclass
class State:
    """What goes on from epoch to epoch: layers, first and second moments of their gradients, and the steps taken."""
    layers: list[dict]
    first: list[dict]
    second: list[dict]
    steps: int = 0
    #: Once a step was taken: what is trained, and its moments, as one array each; the layers are views of them.
    flat: list[np.ndarray] | None = field(default=None, repr=False, compare=False)

    @classmethod
    def start(cls, layers: list[dict]) -> "State":
        zeros = [{k: np.zeros_like(v) for k, v in layer.items()} for layer in layers]
        return cls(layers, zeros, [{k: v.copy() for k, v in layer.items()} for layer in zeros])

    def numbers(self) -> np.ndarray:
        return np.concatenate([flatten(self.layers), flatten(self.first), flatten(self.second)])

    def like(self, numbers: np.ndarray, steps: int) -> "State":
        return State(*[unflatten(part, self.layers) for part in np.split(numbers, 3)], steps)

    def step(self, grads: list[dict], lr: float) -> None:
        """One Adam step, in place."""
        self.steps += 1
        scale = lr * math.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        if self.flat is None:
            self.flat = [_in_one(part) for part in (self.layers, self.first, self.second)]
        weights, m, v = self.flat
        g = np.concatenate([grad[k].ravel() for grad in grads for k in sorted(grad)])
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weights -= scale * m / (np.sqrt(v) + 1e-8)


def _in_one(layers: list[dict]) -> np.ndarray:
    """One array with all that is trained, of which the layers then hold views."""
    trained = [(layer, k) for layer in layers for k in sorted(layer) if k in TRAINED]
    whole, at = np.concatenate([layer[k].ravel() for layer, k in trained]), 0
    for layer, k in trained:
        layer[k] = whole[at:at + layer[k].size].reshape(layer[k].shape)
        at += layer[k].size
    return whole


PACKED = "part long, n int, x binary, y binary, is_val binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, x, y, is_val) of a partition as blocks of matrices, in their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("x")
        ends = np.asarray(lists.offsets)
        x = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(batch.num_rows, -1)
        y, val = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "is_val"))
        step = max(PACKED_CELLS // max(x.shape[1], 1), 1)
        cuts = range(0, len(x), step)
        yield pa.record_batch([
            pa.array([batch.column("part")[0].as_py()] * len(cuts), pa.int64()), pa.array([len(x[i:i + step]) for i in cuts], pa.int32()),
            pa.array([np.ascontiguousarray(x[i:i + step], np.float64).tobytes() for i in cuts], pa.binary()),
            pa.array([y[i:i + step].astype(np.float64).tobytes() for i in cuts], pa.binary()),
            pa.array([val[i:i + step].astype(np.uint8).tobytes() for i in cuts], pa.binary())], names=["part", "n", "x", "y", "is_val"])


SUMS = "part long, block int, rows double, train_loss double, val_rows double, val_loss double, val_hits double, steps long, numbers binary"
_ADDED = ("rows", "train_loss", "val_rows", "val_loss", "val_hits")


def _epoch_task(shipped, p: dict, classes: int | None, lr: float, epoch: int, seed: int, learn: bool, deep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: State = shipped.value
        state = start.like(start.numbers(), start.steps)
        sums, part, rng, held, cells = dict.fromkeys(_ADDED, 0.0), 0, None, [], 0

        def train() -> None:
            x, y = (np.concatenate(c) for c in zip(*held))
            order = rng.permutation(len(x))
            for at in range(0, len(order), p["batch"]):
                pick = order[at:at + p["batch"]]
                out, tape = forward(state.layers, x[pick], p["dropout"], rng)
                slope = loss_and_slope(out, y[pick], classes)[1]
                decay = p["weight_decay"] if deep else p["weight_decay"] / len(pick)
                state.step(gradients(state.layers, tape, slope, decay), lr)
            held.clear()

        for batch in batches:
            for n, packed_x, packed_y, packed_val in zip(*[batch.column(c) for c in ("n", "x", "y", "is_val")]):
                if rng is None:
                    part = batch.column("part")[0].as_py()
                    rng = np.random.default_rng([seed, epoch, part])
                    # the first buffer of an epoch ends elsewhere each time, so rows meet other rows
                    limit = int(BUFFER_CELLS * (0.5 + rng.random() / 2))
                x = np.frombuffer(packed_x.as_buffer(), np.float64).reshape(n.as_py(), -1)
                y = np.frombuffer(packed_y.as_buffer(), np.float64)
                val = np.frombuffer(packed_val.as_buffer(), np.uint8).astype(bool)
                rest = x[~val], y[~val]
                for (some, true), kind in (((x[val], y[val]), "val"), (rest, "train")):
                    if len(some):
                        out = outputs(start.layers, some)
                        sums[f"{kind}_loss"] += loss_and_slope(out, true, classes)[0]
                        sums["val_rows" if kind == "val" else "rows"] += float(len(some))
                        if kind == "val" and classes is not None:
                            sums["val_hits"] += float((out.argmax(1) == true).sum())
                if learn and len(rest[0]):
                    held.append(rest)
                    cells += x.size
                    if cells >= limit:
                        train()
                        cells, limit = 0, BUFFER_CELLS
        if held:
            train()
        if rng is not None:
            numbers = state.numbers() * sums["rows"] if learn else np.zeros(0)
            blocks = [numbers[i:i + STATE_BLOCK] for i in range(0, max(len(numbers), 1), STATE_BLOCK)]
            k = len(blocks)
            yield pa.record_batch([
                pa.array([part] * k, pa.int64()), pa.array(range(k), pa.int32()), *[pa.array([sums[c]] * k, pa.float64()) for c in _ADDED],
                pa.array([state.steps] * k, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["part", "block", *_ADDED, "steps", "numbers"])
    return run


def _add_up(group: pa.Table) -> pa.Table:
    """The sum of some tasks' results for one block, in task order so that the rounding is always the same."""
    order = np.argsort(group["part"].to_numpy(), kind="stable")
    numbers = group["numbers"].combine_chunks()
    total = None
    for i in order.tolist():
        one = np.frombuffer(numbers[i].as_buffer(), np.float64)
        total = one.copy() if total is None else total + one
    sums = {c: float(group[c].to_numpy()[order].sum()) for c in _ADDED}
    return pa.table({"part": pa.array([group["part"][int(order[0])].as_py()], pa.int64()), "block": pa.array([group["block"][0].as_py()], pa.int32()),
                     **{c: pa.array([v], pa.float64()) for c, v in sums.items()},
                     "steps": pa.array([max(group["steps"].to_pylist())], pa.int64()), "numbers": pa.array([total.tobytes()], pa.binary())})


def _merged(parts: DataFrame, tasks: int) -> dict:
    """Sums of the tasks' numbers and measures; above DIRECT_TASKS tasks they are added up in Spark first, level by level."""
    fan = max(DIRECT_TASKS, 2)
    while tasks > DIRECT_TASKS:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(_add_up, SUMS)
        tasks = -(-tasks // fan)
        if tasks == 1:
            break
    table = parts.toArrow()
    blocks = {b: _add_up(table.filter(pc.equal(table["block"], b))).to_pylist()[0] for b in set(table["block"].to_pylist())}
    numbers = np.concatenate([np.frombuffer(blocks[b]["numbers"], np.float64) for b in sorted(blocks)])
    return {**{c: blocks[0][c] for c in (*_ADDED, "steps")}, "numbers": numbers}


@dataclass
class NetCore:
    layers: list[dict]
    classes: int | None
    scale: tuple[float, float] = (0.0, 1.0)       # the target's mean and std, for regression
    history: list[tuple] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    best: float | None = None                     # the least validation loss, whose weights are kept

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        layers, classes, (mean, std) = self.layers, self.classes, self.scale

        @F.arrow_udf("array<double>" if classes else "double")
        def predict(x: pa.Array) -> pa.Array:
            ends = np.asarray(x.offsets)
            flat = x.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]] if len(x) else np.zeros(0)
            got = outputs(layers, flat.reshape(len(x), -1)) if len(x) else np.zeros((0, classes or 1))
            if not classes:
                return pa.array(got[:, 0] * std + mean, pa.float64())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * classes, pa.int32()), pa.array(softmax(got).ravel(), pa.float64()))

        return df.withColumn(out, predict(feature_array(df)))

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double, lr double")


def fit_net(data: DataFrame, name: str, classes: int | None, params: dict, seed: int = 42) -> NetCore:
    """Fit on ``features``/``label``. Rows marked ``_is_val`` only validate; without that
    column a tenth of the rows, by hash, does.

    The plain net keeps its learning rate, and stops when its validation score (accuracy or R2) has not gained LEAST_GAIN
    in more than ``patience`` epochs; its history has 1 - score for the validation loss. The deep net's learning rate halves after
    FLAT_EPOCHS epochs without a better validation loss, and it stops after ``patience`` of them. The best weights are restored.
    """
    p, deep = check_params(name, params), name == "deep_mlp"
    x = vector_to_array("features")
    rows = data.select(x.alias("x"), F.col("label").cast("double").alias("y"), *(["_is_val"] if "_is_val" in data.columns else []))
    if "_is_val" in data.columns:
        rows = rows.withColumnRenamed("_is_val", "is_val")
    else:
        rows = rows.withColumn("is_val", bucket(rows, None, f"netval{seed}") < 1000)
    got = rows.agg(F.avg("y"), F.stddev_pop("y"), F.max(F.size("x")), F.var_pop(F.when(F.col("is_val"), F.col("y")))).first()
    mean, std, width, val_var = got[0] or 0.0, got[1] or 1.0, got[2], got[3]
    if width is None:
        raise ValueError("there are no rows to fit")
    if classes is None:
        rows = rows.withColumn("y", (F.col("y") - F.lit(mean)) / F.lit(std))
    else:
        mean, std = 0.0, 1.0
    unit = std * std                                       # losses in the target's own unit
    packed = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_pack, PACKED).persist(StorageLevel.MEMORY_AND_DISK)
    context = data.sparkSession.sparkContext
    try:
        tasks = packed.agg(F.max("part")).first()[0] + 1
        state = State.start(init_layers([width, *p["hidden"], classes or 1], p["batch_norm"], seed))
        core = NetCore(state.layers, classes, (mean, std), params=p)
        best, flat, lr, best_layers = math.inf, 0, float(p["lr"]), state.layers
        for epoch in range(p["max_epochs"] + 1):           # the last pass only measures
            learn = epoch < p["max_epochs"]
            shipped = context.broadcast(state)             # three times the weights
            total = _merged(packed.mapInArrow(_epoch_task(shipped, p, classes, lr, epoch, seed, learn, deep), SUMS), tasks)
            shipped.destroy()
            train_loss = total["train_loss"] / max(total["rows"], 1) * unit
            val_loss = total["val_loss"] / total["val_rows"] * unit if total["val_rows"] else train_loss
            if not deep and total["val_rows"]:
                val_loss = 1 - total["val_hits"] / total["val_rows"] if classes else val_loss / val_var if val_var else val_loss
            if epoch:                                      # the loss after `epoch` epochs
                core.history.append((epoch, round(train_loss, 5), round(val_loss, 5), lr))
                flat = 0 if val_loss < best - (0.0 if deep else LEAST_GAIN) else flat + 1
                if val_loss < best:
                    best, best_layers = val_loss, state.layers
                if deep and flat and flat % (FLAT_EPOCHS + 1) == 0:
                    lr /= 2
                if flat >= p["patience"] + (not deep):
                    break
            if learn:
                state = state.like(total["numbers"] / max(total["rows"], 1), total["steps"])
        core.layers, core.best = best_layers, best
        return core
    finally:
        packed.unpersist()
