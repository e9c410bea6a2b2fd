"""Logistic regression by Newton steps on sums: any number of penalties share each pass over the rows.

A pass returns, for every penalty that has not settled, the loss, its gradient and its Hessian at the present weights, added up
in the tasks and then in Spark. The driver solves a system of (classes x features), takes the step, and halves it if the
next pass finds the loss risen. With the penalty 1/C on the weights, not on the intercepts, the loss is convex, so the
end does not depend on the way. Two classes have one row of weights, more have one each (softmax).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Unknowns up to which the driver solves the system; wider models are left to MLlib's quasi-Newton search.
MOST_UNKNOWNS = 600
MAX_PASSES, TOLERANCE = 60, 1e-9
FAN = 32


@dataclass
class LogisticCore:
    """Weights (a row for two classes, a row a class for more), intercepts, and the training means of the features."""
    coefficients: list[list[float]]
    intercepts: list[float]
    classes: int
    means: list[float]

    def add_score(self, df: DataFrame, out: str) -> DataFrame:
        from tabspark.operators.models import dot, feature_array
        x = feature_array(df)
        margins = [dot(x, w) + F.lit(float(b)) for w, b in zip(self.coefficients, self.intercepts)]
        if len(margins) == 1:
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margins[0]))
            return df.withColumn(out, F.array(F.lit(1.0) - p, p))
        return df.withColumn(f"_m{out}", F.array(*margins)).withColumn(out, _softmax(F.col(f"_m{out}"))).drop(f"_m{out}")


def _softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    total = F.aggregate(margins, F.lit(0.0), lambda a, m: a + F.exp(m - top))
    return F.transform(margins, lambda m: F.exp(m - top) / total)


def _sums(x: np.ndarray, label: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian, flat, of weights (rows, features + 1) on rows with a column of ones."""
    eta = x @ w.T
    if len(w) == 1:
        y, z = (label == 1).astype(float), eta[:, 0]
        p = 0.5 * (1 + np.tanh(z / 2))
        loss = float((np.logaddexp(0, z) - y * z).sum())
        return np.concatenate([[loss], x.T @ (p - y), ((x.T * (p * (1 - p))) @ x).ravel()])
    top = eta.max(1, keepdims=True)
    e = np.exp(eta - top)
    total = e.sum(1, keepdims=True)
    p = e / total
    loss = float((np.log(total[:, 0]) + top[:, 0] - eta[np.arange(len(x)), label]).sum())
    slope = p.copy()
    slope[np.arange(len(x)), label] -= 1
    k, d = w.shape
    hessian = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            block = (x.T * (p[:, a] * ((a == b) - p[:, b]))) @ x
            hessian[a, :, b, :] = block
            hessian[b, :, a, :] = block.T
    return np.concatenate([[loss], (slope.T @ x).ravel(), hessian.ravel()])


def _pass(rows: DataFrame, weights: list[np.ndarray], tasks: int) -> list[np.ndarray]:
    """The sums of every set of weights over all rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            ends = np.asarray(lists.offsets)
            x = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].reshape(batch.num_rows, -1)
            x, label = np.c_[x, np.ones(len(x))], batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.concatenate([_sums(x, label, w) for w in shipped.value])
            total = found if total is None else total + found
        if total is not None:
            from pyspark import TaskContext
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy(), kind="stable").tolist()
        cells = table["sums"].combine_chunks()
        total = sum((np.frombuffer(cells[i].as_buffer()) for i in order), 0.0)
        return pa.table({"part": table["part"].slice(order[0], 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "part bigint, sums binary")
    if tasks > FAN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(added, "part bigint, sums binary")
    total = sum((np.frombuffer(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["part"])), 0.0)
    shipped.destroy()
    return np.split(total, len(weights))


def fits(width: int, classes: int) -> bool:
    return (1 if classes <= 2 else classes) * (width + 1) <= MOST_UNKNOWNS


def fit_logistic(data: DataFrame, classes: int, strengths: Sequence[float], max_iter: int = MAX_PASSES) -> list[LogisticCore]:
    """A core for each C, on ``features``/``label`` with labels 0..classes-1; all start from the weights of none."""
    rows = data.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    first, last = rows.select(F.size("x").alias("n"), F.spark_partition_id().alias("part")).agg(F.max("n"), F.max("part")).first()
    if first is None:
        raise ValueError("there are no rows to fit")
    tasks = last + 1
    means = list(rows.agg(*[F.avg(F.col("x")[i]) for i in range(first)]).first()) if first else []
    k, d = (1 if classes <= 2 else classes), first + 1
    penalised = np.ones((k, d))
    penalised[:, -1] = 0
    now = [np.zeros((k, d)) for _ in strengths]
    best: list[tuple[float, np.ndarray] | None] = [None] * len(strengths)
    step: list[np.ndarray] = [np.zeros((k, d)) for _ in strengths]
    open_ = list(range(len(strengths)))
    for _ in range(min(max_iter, MAX_PASSES)):
        still = []
        for i, sums in zip(open_, _pass(rows, [now[i] for i in open_], tasks)):
            ridge = 1.0 / float(strengths[i])
            loss = sums[0] + ridge / 2 * float((penalised * now[i] ** 2).sum())
            if best[i] is not None and loss > best[i][0] + 1e-10 * (1 + abs(best[i][0])):
                step[i] = step[i] / 2
                if np.abs(step[i]).max() > TOLERANCE:
                    now[i] = best[i][1] + step[i]
                    still.append(i)
                continue
            slope = sums[1:1 + k * d].reshape(k, d) + ridge * penalised * now[i]
            curve = sums[1 + k * d:].reshape(k * d, k * d) + ridge * np.diag(penalised.ravel())
            best[i] = (loss, now[i])
            step[i] = -np.linalg.lstsq(curve, slope.ravel(), rcond=1e-12)[0].reshape(k, d)
            if np.abs(step[i]).max() > TOLERANCE * (1 + np.abs(now[i]).max()):
                now[i] = now[i] + step[i]
                still.append(i)
        open_ = still
        if not open_:
            break
    out = []
    for _, w in best:
        centre = w[:, -1] - (w[:, -1].mean() if k > 1 else 0.0)
        out.append(LogisticCore(w[:, :-1].tolist(), centre.tolist(), max(classes, 2) if k == 1 else classes, [float(m or 0.0) for m in means]))
    return out
