"""Sums of products over pairs of columns, the one pass behind correlations and ridge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabspark.functions.columns import agg_row, chunks, number

PAIR_LIMIT = 24     # columns up to which one aggregate per pair is cheapest
TILE = 128          # columns of a block
TILES = 48          # tiles of a pass: some 40 MB of sums in a task


SUMS = ("n", "x", "y", "xx", "yy", "xy")


def tiles(columns: int, width: int = TILE) -> list[tuple[int, int]]:
    """Pairs (first, second) of blocks of columns, the first no later than the second."""
    blocks = -(-columns // width)
    return [(a, b) for a in range(blocks) for b in range(a, blocks)]


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for i <= j over rows where both values are present.

    Values are shifted by a rough column mean first, which keeps the sums accurate. The pairs are cut into tiles, a
    block of columns by a block of columns. Each Arrow batch is reduced by matrix products, and a task holds the tiles of one pass
    (TILES of them), never all pairs; a pass reads only the columns of its tiles. Spark adds a tile up over the tasks.
    """
    p, width = len(cols), TILE
    values = df.select([number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = agg_row(values, {f"c{i}": F.avg(f"c{i}") for i in range(p)})
    shift = np.array([means[f"c{i}"] or 0.0 for i in range(p)])
    span = lambda block: range(block * width, min((block + 1) * width, p))

    def partial(some: list[tuple[int, int]]):
        blocks = sorted({x for tile in some for x in tile})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                held = {}
                for block in blocks:
                    x = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in span(block)], 1).astype(float) - shift[list(span(block))]
                    here = ~np.isnan(x)
                    held[block] = np.where(here, x, 0.0), here.astype(float)
                for a, b in some:
                    (x, m), (y, k) = held[a], held[b]
                    found = np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y])
                    total[a, b] = total[a, b] + found if (a, b) in total else found
            part = TaskContext.get().partitionId()
            sums = [total.get((a, b), np.zeros((len(SUMS), len(span(a)), len(span(b))))).tobytes() for a, b in some]
            yield pa.record_batch([pa.array([part] * len(some), pa.int64()), pa.array([a for a, _ in some], pa.int32()),
                                   pa.array([b for _, b in some], pa.int32()), pa.array(sums, pa.binary())], names=["part", "a", "b", "sums"])
        return run

    def added(table: pa.Table) -> pa.Table:
        """A tile over all tasks, in their order, as rows."""
        cells, total = table["sums"].combine_chunks(), None
        for i in np.argsort(table["part"].to_numpy(), kind="stable").tolist():
            one = np.frombuffer(cells[i].as_buffer())
            total = one if total is None else total + one
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        left, right = np.array(span(a)), np.array(span(b))
        i, j = (m.ravel() for m in np.meshgrid(left, right, indexing="ij"))
        keep = i <= j
        sums = total.reshape(len(SUMS), -1)[:, keep]
        return pa.table({"i": pa.array(i[keep], pa.int32()), "j": pa.array(j[keep], pa.int32()), **{c: pa.array(s) for c, s in zip(SUMS, sums)}})

    def one_pass(some: list[tuple[int, int]]) -> DataFrame:
        needed = sorted({i for tile in some for block in tile for i in span(block)})
        parts = values.select([f"c{i}" for i in needed]).mapInArrow(partial(some), "part bigint, a int, b int, sums binary")
        return parts.groupBy("a", "b").applyInArrow(added, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))

    return reduce(DataFrame.unionByName, [one_pass(some) for some in chunks(tiles(p, width), TILES)])


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance matrix of columns without missing values."""
    p = len(cols)
    if p <= PAIR_LIMIT:
        exprs = {"n": F.count(F.lit(1)), **{("m", i): F.avg(number(df, c)) for i, c in enumerate(cols)},
                 **{(i, j): F.covar_pop(number(df, cols[i]), number(df, cols[j]))
                    for i in range(p) for j in range(i, p)}}
        got = agg_row(df, exprs, chunk=400)
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = got[i, j] if got[i, j] is not None else 0.0
        return got["n"], np.array([got["m", i] or 0.0 for i in range(p)]), cov
    rough = agg_row(df, {"n": F.count(F.lit(1)), **{i: F.avg(number(df, c)) for i, c in enumerate(cols)}})
    n, cov = rough["n"], np.zeros((p, p))
    for r in pair_sums(df, cols).collect():           # columns^2 / 2 rows, whatever the table's size
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["xy"] / n - (r["x"] / n) * (r["y"] / n)
    return n, np.array([rough[i] or 0.0 for i in range(p)]), cov
