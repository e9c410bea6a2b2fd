"""Linear models on many parts of a table from one pass: a cube of mergeable sums.

A cell of the cube holds the products of all pairs of a few base columns, summed over its rows. Base columns are one, each numeric
feature (0 where it is missing), a flag for what is missing, a flag for each category, and the target. The
preparation of a training part (median for gaps, scaling; mode for gaps, ordinal codes) makes each feature a weighted sum of
base columns, whose weights depend on the part. So the products of prepared features are sums and differences of cells, and any
number of folds, prefixes and penalties needs no further pass over the rows.

Medians are not sums: those of all parts are taken together, in one search of quantiles, for the columns that have gaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.functions.columns import agg_row, col, number
from tabspark.operators.counting import value_counts_long
from tabspark.operators.models import solve_ridge
from tabspark.operators.prep import UNSEEN, FeatureSpec
from tabspark.operators.quantiles import quantiles

#: Base columns up to which a cell's products are held by every task; tables with more take the separate fits.
MOST_COLUMNS = 300
#: Results of tasks that are added up together.
FAN = 32


@dataclass
class Part:
    """Training and validation cells of a part."""
    train: list[int]
    val: list[int]


class LinearCube:
    """``cells`` numbers the rows' cells from 0; a row without a cell takes no part."""

    def __init__(self, df: DataFrame, spec: FeatureSpec, cell: Column, cells: int):
        self.df, self.spec, self.cell, self.cells = df, spec, cell.cast("int"), cells
        stats: dict = {}
        for c in (*spec.numeric, spec.target):
            stats[c, "mean"], stats[c, "std"] = F.avg(number(df, c)), F.stddev_pop(number(df, c))
            stats[c, "gaps"] = F.count_if(number(df, c).isNull())
        self.stats = agg_row(df, stats)
        self.shift = {c: self.stats[c, "mean"] or 0.0 for c in (*spec.numeric, spec.target)}
        self.scale = {c: self.stats[c, "std"] or 1.0 for c in (*spec.numeric, spec.target)}
        self.gaps = [c for c in spec.numeric if self.stats[c, "gaps"]]
        self.values: dict[str, list[str]] = {c: [] for c in spec.categorical}
        self.fits = self._read_values()

    def _read_values(self) -> bool:
        """The categories, in order; False if there are more than the cube can hold."""
        plain = 2 + len(self.spec.numeric) + len(self.gaps) + len(self.spec.categorical)
        if self.spec.categorical:
            texts = self.df.select([col(c).cast("string").alias(c) for c in self.spec.categorical])
            counted, _ = value_counts_long(texts, list(self.spec.categorical))
            rows = counted.select("c", "v0").where(F.col("v0").isNotNull()).orderBy("c", "v0").limit(MOST_COLUMNS + 1).collect()
            if plain + len(rows) > MOST_COLUMNS:
                return False
            for r in rows:
                self.values[self.spec.categorical[r["c"]]].append(r["v0"])
        return plain <= MOST_COLUMNS

    def _base(self) -> tuple[list[Column], dict]:
        """The base columns, and the place of each by name."""
        df, columns, place = self.df, [F.lit(1.0)], {"one": 0}

        def add(key, column: Column) -> None:
            place[key] = len(columns)
            columns.append(column)

        for c in (*self.spec.numeric, self.spec.target):
            value = number(df, c)
            add(("value", c), F.coalesce((value - self.shift[c]) / self.scale[c], F.lit(0.0)))
            if c in self.gaps:
                add(("gap", c), value.isNull().cast("double"))
        for c in self.spec.categorical:
            text = col(c).cast("string")
            add(("gap", c), text.isNull().cast("double"))
            for v in self.values[c]:
                add(("is", c, v), F.coalesce((text == F.lit(v)).cast("double"), F.lit(0.0)))
        return columns, place

    def measure(self) -> None:
        """One pass: the products of each cell, added up in the tasks, then in Spark."""
        columns, self.place = self._base()
        width, cells = len(columns), self.cells

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cells, width, width))
            some = False
            for batch in batches:
                at = batch.column("cell").to_numpy(zero_copy_only=False)
                x = np.stack([batch.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(width)], 1)
                for cell in np.unique(at).tolist():
                    own = x[at == cell]
                    total[cell] += own.T @ own
                some = True
            if some:
                from pyspark import TaskContext
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                      names=["part", "sums"])

        def added(table: pa.Table) -> pa.Table:
            order = np.argsort(table["part"].to_numpy(), kind="stable").tolist()
            total = sum((np.frombuffer(table["sums"].combine_chunks()[i].as_buffer()) for i in order), 0.0)
            return pa.table({"part": table["part"].slice(order[0], 1), "sums": pa.array([total.tobytes()], pa.binary())})

        rows = self.df.select(self.cell.alias("cell"), *[c.alias(f"b{i}") for i, c in enumerate(columns)]).where("cell is not null")
        parts = rows.mapInArrow(sums, "part bigint, sums binary")
        # two levels of fans in Spark; a thousand tasks leave one cube
        for fan in (FAN, FAN * FAN):
            parts = parts.groupBy(F.floor(F.col("part") / fan).alias("fan")).applyInArrow(added, "part bigint, sums binary")
        self.sums = np.zeros((cells, width, width))
        for r in sorted(parts.collect(), key=lambda r: r["part"]):
            self.sums += np.frombuffer(r["sums"]).reshape(self.sums.shape)

    def medians(self, parts: Sequence[Part]) -> dict[tuple[int, str], float]:
        """The median of each column with gaps over each training part, in one search; in the columns' own scale."""
        if not self.gaps:
            return {}
        named = {f"m{i}_{j}": (i, c) for i, _ in enumerate(parts) for j, c in enumerate(self.gaps)}
        rows = self.df.select([F.when(self.cell.isin(parts[i].train), number(self.df, c)).alias(n) for n, (i, c) in named.items()])
        found = quantiles(rows, list(named), (0.5,))
        return {key: found[n][0] or 0.0 for n, key in named.items()}

    def weights(self, i: int, part: Part, medians: dict) -> np.ndarray:
        """The prepared features and the target of a part, each as a sum of base columns."""
        train = self.sums[part.train].sum(0)
        n, out = train[0, 0], []
        for c in self.spec.numeric:
            w = np.zeros(len(train))
            w[self.place["value", c]] = 1.0
            if c in self.gaps:
                w[self.place["gap", c]] = (medians[i, c] - self.shift[c]) / self.scale[c]
            mean = w @ train[:, 0] / n
            var = max(w @ train @ w / n - mean * mean, 0.0)
            w[0] -= mean
            out.append(w / np.sqrt(var) if var > 1e-20 else w)
        for c in self.spec.categorical:
            w = np.zeros(len(train))
            counts = [train[self.place["is", c, v], 0] for v in self.values[c]]
            codes = {v: float(k) for k, v in enumerate(v for v, n in zip(self.values[c], counts) if n > 0.5)}
            for v in self.values[c]:
                w[self.place["is", c, v]] = codes.get(v, UNSEEN)
            mode = min(zip(counts, self.values[c]), key=lambda x: (-round(x[0]), x[1]), default=(0, None))
            w[self.place["gap", c]] = codes.get(mode[1], UNSEEN)
            out.append(w)
        y = np.zeros(len(train))
        y[self.place["value", self.spec.target]] = 1.0
        return np.array([*out, y])

    def moments(self, cells: list[int], weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows, means and population covariances of weighted base columns over some cells."""
        sums = self.sums[cells].sum(0)
        n = round(sums[0, 0])
        if not n:
            return 0, np.zeros(len(weights)), np.zeros((len(weights),) * 2)
        means = weights @ sums[:, 0] / n
        return n, means, weights @ sums @ weights.T / n - np.outer(means, means)

    def score(self, parts: Sequence[Part], alphas: Sequence[float]) -> list[dict]:
        """For each part its training rows and, for each penalty, R2 on the training and on the validation cells."""
        medians, out = self.medians(parts), []
        for i, part in enumerate(parts):
            if round(self.sums[part.train].sum(0)[0, 0]) == 0:
                out.append({"n": 0, "train": [float("nan")] * len(alphas), "val": [float("nan")] * len(alphas)})
                continue
            w = self.weights(i, part, medians)
            fit, val = self.moments(part.train, w), self.moments(part.val, w)
            lines = [solve_ridge(*fit, a) for a in alphas]
            out.append({"n": fit[0], "train": [r2(fit, *line) for line in lines], "val": [r2(val, *line) for line in lines]})
        return out


def r2(moments: tuple[int, np.ndarray, np.ndarray], w: np.ndarray, b: float) -> float:
    """R2 of a line on rows known by their moments; not a number without rows."""
    n, means, cov = moments
    if not n:
        return float("nan")
    shift = means[-1] - b - w @ means[:-1]
    mse = cov[-1, -1] - 2 * w @ cov[:-1, -1] + w @ cov[:-1, :-1] @ w + shift ** 2
    return float(1 - mse / cov[-1, -1]) if cov[-1, -1] > 1e-20 else float(mse <= 1e-20)
