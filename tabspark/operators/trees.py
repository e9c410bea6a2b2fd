"""Contributions of features to a tree model's output, for whole tables and models of any size.

A fitted tree is a set of leaves, each with a value and, for every feature on its path, an
interval of values and the share of training rows that the path kept at that feature's
splits. For one leaf, the Shapley value of feature i in the game where an absent feature
passes with its share z and a present one passes if the row does (o = 1) or not (o = 0) is

    value * (o_i - z_i) * integral over t in 0..1 of prod_{j != i} (z_j (1 - t) + o_j t)

The integrand is a polynomial, so a Gauss-Legendre rule with enough nodes is exact.
Contributions and base sum to the model's output by construction.

Leaves are cut out of the saved model by Spark, a tree a task, and packed by the number of their features: leaves of equal
depth are arrays, and rows meet all of them at once. A leaf of few features knows the contributions of each pattern
of passes beforehand, and a row looks its pattern up. The packed leaves are a table; they reach the rows in rounds of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.session import scratch_path

#: Numbers (leaf, feature) of a packed block, and bytes of the blocks that go to the tasks at once.
BLOCK_CELLS, ROUND_BYTES = 1 << 14, 64 << 20
#: Features up to which a leaf's patterns are looked up; above, every row is integrated.
TABLE_DEPTH = 6
#: Numbers (row, leaf) that are held at once.
ROW_CELLS = 1 << 19

PACKED = "depth int, leaves int, expected double, value binary, feature binary, low binary, high binary, share binary"
_KINDS = {"value": np.float64, "feature": np.int32, "low": np.float64, "high": np.float64, "share": np.float64}


def _nodes(spark: SparkSession, model) -> DataFrame:
    """The model's nodes, as MLlib saves them."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" not in nodes.columns:        # a single tree
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    data = F.col("nodeData")
    return nodes.select("treeID", data["id"].alias("id"), data["prediction"].alias("prediction"), data["impurityStats"].alias("stats"),
                        data["leftChild"].alias("left"), data["rightChild"].alias("right"),
                        data["split"]["featureIndex"].alias("feature"), F.get(data["split"]["leftCategoriesOrThreshold"], 0).alias("cut"))


def packed(leaves: list[tuple[float, dict]]) -> pa.Table:
    """Leaves (value, {feature: (low, high, share)}) as blocks of equal depth."""
    by_depth: dict[int, list] = {}
    for value, path in leaves:
        by_depth.setdefault(len(path), []).append((value, path))
    rows = []
    for depth, some in sorted(by_depth.items()):
        step = max(BLOCK_CELLS // max(depth, 1), 1)
        for at in range(0, len(some), step):
            part = some[at:at + step]
            value = np.array([v for v, _ in part], np.float64)
            feature = np.array([sorted(p) for _, p in part], np.int32).reshape(len(part), depth)
            low, high, share = (np.array([[p[f][k] for f in sorted(p)] for _, p in part], np.float64).reshape(len(part), depth) for k in range(3))
            rows.append((depth, len(part), float((value * share.prod(1)).sum()), *[a.tobytes() for a in (value, feature, low, high, share)]))
    names = [c.split(" ")[0] for c in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def leaf_blocks(spark: SparkSession, model, classes: int | None, boosted: bool, factor: float = 1.0) -> DataFrame:
    """The packed leaves of a forest (mean over trees; last class for classification) or of boosted
    trees (weighted sum, so margins for classification)."""
    weights = [float(w) for w in model.treeWeights]
    as_class = classes is not None and not boosted

    def cut(tree: pa.Table) -> pa.Table:
        nodes = {n["id"]: n for n in tree.to_pylist()}
        scale = factor * (weights[tree["treeID"][0].as_py()] if boosted else 1.0 / len(weights))

        def size(node) -> float:
            return float(sum(node["stats"]) if as_class else node["stats"][0])

        def value(node) -> float:
            if not as_class:
                return float(node["prediction"])
            stats = node["stats"]
            return float(stats[classes - 1] / sum(stats)) if len(stats) >= classes else 0.0

        out, stack = [], [(nodes[0], {})]
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                out.append((scale * value(node), path))
                continue
            f, split = node["feature"], node["cut"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            left, right = nodes[node["left"]], nodes[node["right"]]
            total = size(left) + size(right)
            stack.append((left, {**path, f: (low, min(high, split), share * size(left) / total)}))
            stack.append((right, {**path, f: (max(low, split), high, share * size(right) / total)}))
        return packed(out)

    return _nodes(spark, model).groupBy("treeID").applyInArrow(cut, PACKED)


def kept(blocks: DataFrame) -> tuple[DataFrame, float]:
    """The blocks written once, and the output that they start from."""
    path = scratch_path(blocks.sparkSession, "leaves")
    blocks.write.parquet(path)
    table = blocks.sparkSession.read.schema(blocks.schema).parquet(path)
    return table, float(table.agg(F.sum("expected")).first()[0] or 0.0)


class LeafGroup:
    """Leaves of equal depth, ready to meet rows."""

    def __init__(self, depth: int, value, feature, low, high, share):
        self.depth, self.value, self.feature, self.low, self.high, self.share = depth, value, feature, low, high, share
        # the features at each place of the paths, and which leaf has which
        self.at = []
        for j in range(depth):
            names, which = np.unique(feature[:, j], return_inverse=True)
            spread = np.zeros((len(value), len(names)))
            spread[np.arange(len(value)), which] = 1
            self.at.append((names, spread))
        self.table = None
        if depth <= TABLE_DEPTH:
            passes = (np.arange(1 << depth)[:, None] >> np.arange(depth) & 1).astype(float)
            # (leaf, pattern, feature), as one array for each feature
            table = self.contributions(passes[None], slice(None))
            self.table = [np.ascontiguousarray(table[:, :, j]).ravel() for j in range(depth)]

    def contributions(self, passes: np.ndarray, leaves: slice) -> np.ndarray:
        """Of passes (leaf or 1, pattern or row, feature)."""
        share = self.share[leaves, None, :]
        nodes, weights = np.polynomial.legendre.leggauss((self.depth + 1) // 2)
        total = 0.0
        for t, w in zip((nodes + 1) / 2, weights / 2):
            factors = share * (1 - t) + passes * t
            total = total + w * factors.prod(2, keepdims=True) / factors
        return total * self.value[leaves, None, None] * (passes - share)

    def add(self, phi: np.ndarray, x: np.ndarray) -> None:
        """Add the contributions to those of the rows."""
        m, d = len(self.value), self.depth
        step = max(ROW_CELLS // (m if self.table is not None else m * d), 1)
        for at in range(0, len(x), step):
            part, out = x[at:at + step], phi[at:at + step]
            if self.table is not None:
                place = np.zeros((len(part), m), np.int64) + (np.arange(m) << d)
                for j in range(d):
                    values = part[:, self.feature[:, j]]
                    place += ((values > self.low[:, j]) & (values <= self.high[:, j])).astype(np.int64) << j
                for (names, spread), table in zip(self.at, self.table):
                    out[:, names] += table[place] @ spread
            else:
                values = part[:, self.feature].transpose(1, 0, 2)
                got = self.contributions(((values > self.low[:, None]) & (values <= self.high[:, None])).astype(float), slice(None))
                for j, (names, spread) in enumerate(self.at):
                    out[:, names] += got[:, :, j].T @ spread


def groups(blocks: list[dict]) -> list[LeafGroup]:
    """Blocks as rows of the packed table, those of equal depth put together up to the size of one."""
    out, held = [], {}

    def close(depth: int) -> None:
        some = held.pop(depth, [])
        if some and depth:
            arrays = {c: np.concatenate([np.frombuffer(b[c], k) for b in some]) for c, k in _KINDS.items()}
            out.append(LeafGroup(depth, arrays["value"], *[arrays[c].reshape(-1, depth) for c in ("feature", "low", "high", "share")]))

    for b in blocks:
        depth = b["depth"]
        if (sum(x["leaves"] for x in held.get(depth, [])) + b["leaves"]) * max(depth, 1) > BLOCK_CELLS:
            close(depth)
        held.setdefault(depth, []).append(b)
    for depth in list(held):
        close(depth)
    return out


def _rounds(blocks: DataFrame, limit: int) -> Iterator[list[dict]]:
    """The blocks a round at a time; the driver holds one round."""
    some, size = [], 0
    total = blocks.agg(F.sum(sum((F.octet_length(c) for c in _KINDS), F.lit(0)).cast("bigint"))).first()[0] or 0
    for row in blocks.collect() if total <= limit else blocks.toLocalIterator():
        block = row.asDict()
        bytes_ = sum(len(block[c]) for c in _KINDS)
        if some and size + bytes_ > limit:
            yield some
            some, size = [], 0
        some.append(block)
        size += bytes_
    yield some


def tree_contributions(df: DataFrame, blocks: DataFrame, row_id: str) -> DataFrame:
    """(row_id, x, phi): the features of prepared rows and the array of their contributions.

    Models of more than one round keep the sums of the rounds before beside the rows, written to the shared folder.
    """
    kind, spark = df.schema[row_id].dataType.simpleString(), df.sparkSession
    schema = f"row_id {kind}, x array<double>, phi array<double>"
    rows = df.select(F.col(row_id).alias("row_id"), F.col("_x").alias("x"))
    waiting = None
    for some in _rounds(blocks, ROUND_BYTES):
        if waiting is not None:
            path = scratch_path(spark, "contributions")
            waiting.write.parquet(path)
            rows = spark.read.schema(waiting.schema).parquet(path)
        waiting = rows.mapInArrow(_adder(spark.sparkContext.broadcast(some)), schema)
    return waiting


def _adder(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = groups(shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            ends = np.asarray(lists.offsets)
            x = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(batch.num_rows, -1)
            phi = np.zeros(x.shape)
            if "phi" in batch.schema.names:
                before = batch.column("phi")
                ends = np.asarray(before.offsets)
                phi += before.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(x.shape)
            for group in model:
                group.add(phi, x)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(phi.ravel()))
            yield pa.record_batch([batch.column("row_id"), lists, found], names=["row_id", "x", "phi"])
    return run
