"""Exact, linearly interpolated quantiles of many columns at once.

Spark's ``percentile`` keeps every distinct value of a column in one buffer, which is fine
for a table of known small size and hopeless for a large one. Above ``SMALL_CELLS`` the
order statistics are instead narrowed down:

1. one scan builds mergeable sketches (merged in two levels) that propose a narrow bracket
   around every wanted rank;
2. one scan counts exactly how many values lie below, on and between the bracket ends, so a
   poor bracket costs another round and never a wrong answer;
3. one scan keeps the values strictly inside the brackets; only this thin extract is
   searched further, by value counts, so repeated values collapse before any shuffle.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.functions.columns import agg_row, chunks, number

SMALL_CELLS = 1_000_000    # rows x columns up to which one `percentile` aggregate is bounded
SMALL_BRACKET = 20_000     # candidates per rank that may be finished on the driver
SKETCH_K = 2048            # sketch size; its rank error stays well below BRACKET
BRACKET = 0.004            # half width of a proposed bracket, as a fraction of the ranks
MERGE_GROUPS = 64          # first merge level of the sketches


@dataclass
class _Rank:
    """The value wanted is the ``k``-th smallest (from 0) of a column with ``n`` values."""
    column: int
    k: int
    n: int
    low: float | None = None    # the answer is strictly above low ...
    high: float | None = None   # ... and strictly below high (None: no limit)
    below: int = 0              # exact number of values <= low
    inside: int = 0             # exact number of values in (low, high)
    answer: float | None = None

    def narrow(self, a: float, b: float, lt_a: int, eq_a: int, between: int, eq_b: int) -> None:
        """Use exact counts (of this rank's candidates) around a <= b."""
        k = self.k - self.below
        if k < lt_a:
            self.high, self.inside = a, lt_a
        elif k < lt_a + eq_a:
            self.answer = a
        elif k < lt_a + eq_a + between:
            self.low, self.high, self.inside = a, b, between
            self.below += lt_a + eq_a
        elif k < lt_a + eq_a + between + eq_b:
            self.answer = b
        else:
            seen = lt_a + eq_a + between + eq_b
            self.low, self.below, self.inside = b, self.below + seen, self.inside - seen

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > self.low)
        if self.high is not None:
            test = test & (value < self.high)
        return test


def _count(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def _sketch(values: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sketch per column and ``by`` group, first within groups of partitions, then overall."""
    spread = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_g")
    level1 = values.groupBy(*by, spread).agg(
        *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in names],
        *[F.count(c).alias(f"n_{c}") for c in names])
    # a sketch that saw no value cannot be merged or asked
    return level1.groupBy(*by).agg(
        *[F.kll_merge_agg_double(F.when(F.col(f"n_{c}") > 0, F.col(c))).alias(c) for c in names],
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in names])


def _clamped(x: float) -> float:
    return min(1.0, max(0.0, x))


def _candidates(extract: DataFrame, ranks: dict[int, _Rank]) -> DataFrame:
    """(rank, want, v): the extract's values inside each rank's interval."""
    table = extract.sparkSession.createDataFrame(          # a few rows per column and quantile
        [(i, r.column, r.low, r.high, r.k - r.below) for i, r in ranks.items()],
        "rank int, c int, low double, high double, want long")
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    return (extract.join(F.broadcast(table), "c")
            .filter((low.isNull() | (v > low)) & (high.isNull() | (v < high)))
            .select("rank", "want", "v"))


def _finish_on_extract(extract: DataFrame, ranks: dict[int, _Rank]) -> None:
    """Search the persisted (column, value) extract until every rank has its answer."""
    while todo := {i: r for i, r in ranks.items() if r.answer is None}:
        small = {i: r for i, r in todo.items() if r.inside <= SMALL_BRACKET}
        if small:
            upto = Window.partitionBy("rank").orderBy("v")      # at most SMALL_BRACKET rows each
            found = (_candidates(extract, small).groupBy("rank", "want", "v").agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("upto", F.sum("n").over(upto))
                     .filter(F.col("upto") > F.col("want")).groupBy("rank").agg(F.min("v")))
            for i, answer in found.collect():
                ranks[i].answer = answer
            continue
        cand = _candidates(extract, todo)
        order = list(todo)
        fractions = [_clamped((r.k - r.below + side) / r.inside + shift)
                     for r in todo.values() for side, shift in ((0, -BRACKET), (1, BRACKET))]
        asked = F.kll_sketch_get_quantile_double("v", F.array(*[F.lit(f) for f in fractions]))
        ends = []
        for i, answers in _sketch(cand, ["v"], ["rank"]).select("rank", asked).collect():
            at = 2 * order.index(i)
            ends.append((i, answers[at], answers[at + 1]))
        ends = extract.sparkSession.createDataFrame(ends, "rank int, a double, b double")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counts = (cand.join(F.broadcast(ends), "rank").groupBy("rank", "a", "b")
                  .agg(_count(v < a), _count(v == a), _count((v > a) & (v < b)), _count((v == b) & (a < b))))
        for i, *found in counts.collect():
            ranks[i].narrow(*found)


def _order_statistics(values: DataFrame, names: list[str],
                      probs: Sequence[float]) -> tuple[list[int], dict[tuple[int, int], float]]:
    """Values per column, and {(column index, k): k-th smallest} for the ranks ``probs`` need."""
    merged = _sketch(values, names)
    wanted = F.array(*[F.lit(_clamped(p + d)) for p in probs for d in (-BRACKET, BRACKET)])
    row = merged.select(
        *[F.when(F.col(f"n_{c}") > 0, F.kll_sketch_get_quantile_double(c, wanted)).alias(c) for c in names],
        *[F.col(f"n_{c}") for c in names]).first()
    ranks: dict[int, _Rank] = {}
    ends: dict[int, tuple[float, float]] = {}
    for j, name in enumerate(names):
        n = row[f"n_{name}"] or 0
        for p_index, p in enumerate(probs):
            for k in sorted({math.floor(p * (n - 1)), math.ceil(p * (n - 1))}) if n else ():
                ends[len(ranks)] = (row[name][2 * p_index], row[name][2 * p_index + 1])
                ranks[len(ranks)] = _Rank(j, k, n, inside=n)
    tests = {}                  # ranks with the same bracket share its counts
    for i, rank in ranks.items():
        v, (a, b) = F.col(names[rank.column]), ends[i]
        around = [v < a, v == a, (v > a) & (v < b)] + ([v == b] if a < b else [])
        tests.update({(rank.column, a, b, c): _count(test) for c, test in enumerate(around)})
    counts = agg_row(values, tests)
    for i, rank in ranks.items():
        rank.narrow(*ends[i], *[counts.get((rank.column, *ends[i], c), 0) for c in range(4)])
    tests = {}
    for rank in ranks.values():
        if rank.answer is None:
            inside = rank.holds(F.col(names[rank.column]))
            tests[rank.column] = tests[rank.column] | inside if rank.column in tests else inside
    if tests:
        hits = [F.when(test, F.struct(F.lit(j).alias("c"), F.col(names[j]).alias("v"))) for j, test in tests.items()]
        any_hit = functools.reduce(operator.or_, tests.values())
        extract = (values.filter(any_hit).select(F.inline(F.array_compact(F.array(*hits))))
                   .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            _finish_on_extract(extract, ranks)
        finally:
            extract.unpersist()
    return [row[f"n_{c}"] or 0 for c in names], {(r.column, r.k): r.answer for r in ranks.values()}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              small_cells: int = SMALL_CELLS) -> dict[str, list[float | None]]:
    """Exact quantiles per column (linear interpolation); ``None`` for an empty column."""
    cols, out = list(cols), {}
    if not cols:
        return out
    small = df.select(F.lit(1)).count() * len(cols) <= small_cells
    for part in chunks(cols, 100):
        names = [f"c{i}" for i in range(len(part))]
        values = df.select([number(df, c).alias(n) for c, n in zip(part, names)])
        if small:
            fractions = F.array(*[F.lit(float(p)) for p in probs])
            row = values.agg(*[F.percentile(n, fractions).alias(n) for n in names]).first()
            out.update({c: list(row[n]) if row[n] is not None else [None] * len(probs)
                        for c, n in zip(part, names)})
            continue
        sizes, stats = _order_statistics(values, names, probs)
        for j, c in enumerate(part):
            n = sizes[j]
            out[c] = []
            for p in probs:
                if not n:
                    out[c].append(None)
                    continue
                position = p * (n - 1)
                lo, hi = math.floor(position), math.ceil(position)
                a, b = stats[j, lo], stats[j, hi]
                out[c].append(a if lo == hi else a * (hi - position) + b * (position - lo))
    return out

