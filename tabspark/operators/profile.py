"""Profiling: wide aggregates over a table, returned as small DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabspark.functions.columns import (agg_row, chunks, classify_columns, col, half_even, number, numeric_columns,
                                        percent, present, stack_rows)
from tabspark.functions.hashing import bucket
from tabspark.operators.counting import distinct_at_most, value_counts_long
from tabspark.operators.gram import PAIR_LIMIT, pair_sums
from tabspark.operators.quantiles import quantiles

IQR_K = 1.5


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionAll, frames)


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share, numeric and other columns."""
    kinds = classify_columns(df.schema)
    missing = functools.reduce(
        Column.__add__, [F.count(F.lit(1)) - F.count(present(df, c)) for c in df.columns])
    wide = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"))
    cells = F.col("rows") * len(df.columns)
    return wide.select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "missing",
        percent(F.col("missing"), cells, 2).alias("missing_pct"),
        F.lit(len(kinds.numeric)).cast("bigint").alias("numeric_columns"),
        F.lit(len(df.columns) - len(kinds.numeric)).cast("bigint").alias("other_columns"))


def delta(raw: DataFrame, current: DataFrame) -> DataFrame:
    """Change in rows and columns of the working table against the raw one."""
    signed = raw.agg((-F.count(F.lit(1))).alias("n")).unionAll(current.agg(F.count(F.lit(1)).alias("n")))
    return signed.agg(F.sum("n").alias("delta_rows")).withColumn(
        "delta_columns", F.lit(len(current.columns) - len(raw.columns)).cast("bigint"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = IQR_K) -> dict[str, tuple[float, float]]:
    """[Q1 - k IQR, Q3 + k IQR] per column; columns without any value are left out."""
    return {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
            for c, (q1, q3) in quantiles(df, cols, (0.25, 0.75)).items() if q1 is not None}


def _outliers(df: DataFrame, name: str, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return F.lit(0).cast("bigint")
    value = number(df, name)
    return F.count(F.when((value < bounds[0]) | (value > bounds[1]), F.lit(1)))


def quality_report(df: DataFrame, k: float = IQR_K) -> DataFrame:
    """One row per column: type, missing and IQR-outlier counts and shares."""
    numeric = numeric_columns(df)
    bounds = iqr_bounds(df, numeric, k)
    frames = []
    for part in chunks(df.columns, 100):
        aggs, rows = [F.count(F.lit(1)).alias("rows")], []
        for i, c in enumerate(part):
            is_number = c in numeric
            aggs.append((F.count(F.lit(1)) - F.count(present(df, c))).alias(f"m{i}"))
            if is_number:
                aggs.append(_outliers(df, c, bounds.get(c)).alias(f"o{i}"))
            out = F.col(f"o{i}") if is_number else F.lit(None).cast("bigint")
            rows.append([F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                         F.col(f"m{i}").alias("missing"),
                         percent(F.col(f"m{i}"), F.col("rows")).alias("missing_pct"),
                         out.alias("outliers"), percent(out, F.col("rows")).alias("outlier_pct")])
        frames.append(stack_rows(df.agg(*aggs), rows))
    return _union(frames)


def columns_over_missing(df: DataFrame, pct: float = 50) -> DataFrame:
    """Columns whose rounded share of missing values is strictly over ``pct``."""
    return missing_counts(df).filter(F.col("missing_pct") > pct)


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values, their count and share."""
    frames = []
    for part in chunks(df.columns, 200):
        aggs = [F.count(F.lit(1)).alias("rows")]
        aggs += [(F.count(F.lit(1)) - F.count(present(df, c))).alias(f"m{i}") for i, c in enumerate(part)]
        rows = [[F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
                 percent(F.col(f"m{i}"), F.col("rows")).alias("missing_pct")] for i, c in enumerate(part)]
        frames.append(stack_rows(df.agg(*aggs), rows))
    return _union(frames).filter("missing > 0")


def outlier_counts(df: DataFrame, k: float = IQR_K) -> DataFrame:
    """Numeric columns with values outside their IQR bounds, for a chosen multiplier."""
    bounds = iqr_bounds(df, numeric_columns(df), k)
    frames = []
    for part in chunks(list(bounds), 200):
        if not part:
            return df.sparkSession.createDataFrame([], "column string, outliers bigint")
        wide = df.agg(*[_outliers(df, c, bounds[c]).alias(f"o{i}") for i, c in enumerate(part)])
        frames.append(stack_rows(wide, [[F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers")]
                                        for i, c in enumerate(part)]))
    return _union(frames).filter("outliers > 0")


def describe(df: DataFrame) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column, to 2 digits."""
    numeric = numeric_columns(df)
    if not numeric:
        return df.sparkSession.createDataFrame([], "column string, count bigint, mean double, std double, min double, q25 double, "
                                                   "median double, q75 double, max double")
    quartiles = quantiles(df, numeric, (0.25, 0.5, 0.75))
    frames = []
    for part in chunks(numeric, 50):
        aggs, rows = [], []
        for i, c in enumerate(part):
            v = number(df, c)
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                     F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
            q = [F.lit(x).cast("double") for x in quartiles[c]]
            stats = {"mean": F.col(f"a{i}"), "std": F.col(f"s{i}"), "min": F.col(f"l{i}"),
                     "q25": q[0], "median": q[1], "q75": q[2], "max": F.col(f"h{i}")}
            rows.append([F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                         *[half_even(e, 2).alias(name) for name, e in stats.items()]])
        frames.append(stack_rows(df.agg(*aggs), rows))
    return _union(frames)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long (a, b, corr): Pearson correlation of every pair of numeric columns.

    Pairs use the rows where both values are present; a constant side gives NULL. Up to
    ``PAIR_LIMIT`` columns all pairs come from one aggregate; wider tables sum their
    products block by block inside the tasks.
    """
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    if len(cols) > PAIR_LIMIT:
        sums = pair_sums(df, cols)
        n = F.nullif(F.col("n"), F.lit(0.0))
        sxy = F.col("xy") - F.col("x") * F.col("y") / n
        sxx = F.col("xx") - F.col("x") * F.col("x") / n
        syy = F.col("yy") - F.col("y") * F.col("y") / n
        flat = (sxx <= F.col("xx") * 1e-12) | (syy <= F.col("yy") * 1e-12)     # constant up to rounding
        upper = sums.select("i", "j", F.when(~flat, F.try_divide(sxy, F.sqrt(sxx * syy))).alias("corr"))
        names = F.array(*[F.lit(c) for c in cols])
        both = upper.unionAll(upper.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
        return both.select(F.element_at(names, F.col("i") + 1).alias("a"),
                           F.element_at(names, F.col("j") + 1).alias("b"), "corr")
    aggs, rows = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            x, y = number(df, a), number(df, cols[j])
            r = F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
            aggs.append(r.alias(f"r{i}_{j}"))
            for p, q in {(a, cols[j]), (cols[j], a)}:
                rows.append([F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}_{j}").alias("corr")])
    return stack_rows(df.agg(*aggs), rows)


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """([by], bin, bin_low, bin_high, n): equal-width bins of the finite values; the last is closed.

    Infinite values are counted beside them, in bins -1 and ``bins``.
    """
    value = number(df, column)
    finite = F.when(F.abs(value) < float("inf"), value)
    limits = agg_row(df, {"lo": F.min(finite), "hi": F.max(finite)})
    lo, hi = limits["lo"], limits["hi"]
    groups = [] if by is None else [present(df, by).alias(by)]
    if lo is None:
        return (df.select(*groups, F.lit(0).cast("bigint").alias("bin"), value.alias("bin_low"),
                          value.alias("bin_high"), F.lit(0).cast("bigint").alias("n")).filter("false"))
    width = (hi - lo) / bins or 1.0
    inside = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    slot = F.when(F.col("_v") == float("inf"), F.lit(bins).cast("bigint")).when(
        F.col("_v") == float("-inf"), F.lit(-1).cast("bigint")).otherwise(inside)
    counted = (df.select(*groups, value.alias("_v")).filter("_v is not null")
               .groupBy(*([by] if by else []), slot.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    low, high = F.lit(lo) + F.col("bin") * F.lit(width), F.lit(lo) + (F.col("bin") + 1) * F.lit(width)
    return counted.select(*([by] if by else []), "bin",
                          F.when(F.col("bin") < 0, F.lit(float("-inf"))).otherwise(low).alias("bin_low"),
                          F.when(F.col("bin") >= bins, F.lit(float("inf"))).otherwise(high).alias("bin_high"), "n")


BOX_SLICES = 256       # slices of a group's values, cut at estimated quantiles


def _slice(value: Column, edges: list[float], low: int = 0, high: int | None = None) -> Column:
    """How many edges lie below a value: a binary search, as a tree of conditions."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value > F.lit(float(edges[middle])), _slice(value, edges, middle + 1, high)).otherwise(_slice(value, edges, low, middle))


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """([by], q1, median, q3, whiskers, outliers): the numbers behind a box plot.

    Any number of groups of any size: equal values of a group collapse before the shuffle, and the rest
    is ranked in two steps, over slices of the value range and inside each slice.
    """
    value = number(df, column)
    keep = [] if by is None else ["_g"]
    rows = df.select(*([] if by is None else [present(df, by).alias("_g")]), value.alias("_v")).filter("_v is not null")
    rows = rows if by is None else rows.filter("_g is not null")
    counted = rows.groupBy(*keep, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # slices follow the values; where they are cut decides how even the work is, never the result
    edges = rows.approxQuantile("_v", [i / BOX_SLICES for i in range(1, BOX_SLICES)], 0.01)
    counted = counted.withColumn("_s", _slice(F.col("_v"), sorted(set(edges))))
    sizes = counted.groupBy(*keep, "_s").agg(F.sum("_n").alias("_m"))
    ahead = Window.partitionBy(*keep).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keep, "_s", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_a"),
                          F.sum("_m").over(Window.partitionBy(*keep)).alias("_t"))
    within = Window.partitionBy(*keep, "_s").orderBy("_v")
    ranked = counted.withColumn("_b", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(starts, [*keep, "_s"]).withColumn("_first", F.col("_a") + F.coalesce("_b", F.lit(0)))
    # the value of rank r is the one whose copies span it; a quartile lies between two ranks
    place = {name: (F.col("_t") - 1) * p for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    at = lambda r: F.max(F.when((F.col("_first") <= r) & (r < F.col("_first") + F.col("_n")), F.col("_v")))
    q = ranked.groupBy(*keep).agg(
        F.max("_t").alias("n"), *[at(F.floor(r)).alias(f"{n}_low") for n, r in place.items()],
        *[at(F.ceil(r)).alias(f"{n}_high") for n, r in place.items()])
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        part = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        q = q.withColumn(name, F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part)
    q = q.select(*keep, "n", "q1", "median", "q3").withColumns({
        "_lo": F.col("q1") - IQR_K * (F.col("q3") - F.col("q1")), "_hi": F.col("q3") + IQR_K * (F.col("q3") - F.col("q1"))})
    met = counted.join(q, keep) if keep else counted.withColumn("_1", F.lit(1)).join(q.withColumn("_1", F.lit(1)), "_1")
    low, high = F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")
    box = met.groupBy(*keep, "n", "q1", "median", "q3").agg(
        F.min(F.when(low, F.col("_v"))).alias("whisker_low"), F.max(F.when(high, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~low | ~high, F.col("_n"))), F.lit(0)).alias("outliers"))
    return box if by is None else box.withColumnRenamed("_g", by)


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = 5000,
                   key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``n`` points: the rows with the smallest key hash."""
    cols = list(dict.fromkeys([x, y] + ([hue] if hue else [])))
    return (df.withColumn("_h", bucket(df, key, f"scatter{seed}", 2 ** 32))
            .select("_h", *[col(c) for c in dict.fromkeys([*(key or []), *cols])])
            .orderBy("_h", *[col(c) for c in dict.fromkeys([*(key or []), *cols])]).limit(n).drop("_h"))


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts of all points on a bins x bins grid, for tables too large to draw."""
    vx, vy = number(df, x), number(df, y)
    lim = agg_row(df, {"x0": F.min(vx), "x1": F.max(vx), "y0": F.min(vy), "y1": F.max(vy)})

    def slot(v: Column, lo: float, hi: float) -> Column:
        return F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins or 1.0)), F.lit(bins - 1).cast("bigint"))

    both = df.select(vx.alias("x"), vy.alias("y")).filter("x is not null and y is not null")
    if lim["x0"] is None or lim["y0"] is None:
        return both.selectExpr("0L as x_bin", "0L as y_bin", "0L as n").filter("false")
    return (both.groupBy(slot(F.col("x"), lim["x0"], lim["x1"]).alias("x_bin"),
                         slot(F.col("y"), lim["y0"], lim["y1"]).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def input_domains(df: DataFrame, features: Sequence[str], limit: int = 15) -> DataFrame:
    """(feature, kind, choice, default): what a scoring form offers per feature.

    A categorical feature has a row for each of its values, however many; so has a numeric one with
    at most ``limit`` distinct values. Other numeric features have one row with their median
    (whole for integer columns). The values stay in the table's tasks.
    """
    kinds = classify_columns(df.select([col(c) for c in features]).schema)
    few = distinct_at_most(df, list(kinds.numeric), limit)
    free = [c for c in kinds.numeric if few[c] is None]
    medians = quantiles(df, free, (0.5,))
    rows = []
    for c in free:
        middle = medians[c][0]
        whole = isinstance(df.schema[c].dataType, T.IntegralType) and middle is not None
        rows.append((c, "number", None, float(int(middle)) if whole else middle))
    table = df.sparkSession.createDataFrame(rows, "feature string, kind string, choice string, default double")
    listed = [c for c in features if c in kinds.categorical or c in few and few[c] is not None]
    if not listed:
        return table
    counted, fields = value_counts_long(df, listed)
    text = F.coalesce(*[F.col(f).cast("string") for f in dict.fromkeys(fields)])
    names = F.array(*[F.lit(c) for c in listed])
    choices = counted.select(F.element_at(names, F.col("c") + 1).alias("feature"), F.lit("choice").alias("kind"), text.alias("choice"),
                             F.lit(None).cast("double").alias("default"))
    return table.unionByName(choices)


def detect_task(df: DataFrame, target: str) -> str:
    """'regression' for fractional types and for more than 20 distinct values, else
    'classification'."""
    kind = df.schema[target].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "regression"
    return "regression" if distinct_at_most(df, [target], 20)[target] is None else "classification"
