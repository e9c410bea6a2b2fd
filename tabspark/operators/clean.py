"""Cleaning steps: DataFrame to DataFrame, with statistics from at most one job per step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.functions.columns import agg_row, col, number, numeric_columns, present
from tabspark.functions.formula import formula_column
from tabspark.operators.counting import modes
from tabspark.operators.profile import IQR_K, columns_over_missing, iqr_bounds
from tabspark.operators.quantiles import quantiles

METHODS = ("median", "mean", "mode", "constant")


def with_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or append columns, keeping the table's column order."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in new.items() if c not in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    gone = set(cols)
    return df.select([col(c) for c in df.columns if c not in gone])


def sparse_columns(df: DataFrame, pct: float = 50) -> list[str]:
    over = {r["column"] for r in columns_over_missing(df, pct).collect()}      # column names only
    return [c for c in df.columns if c in over]


def drop_sparse_columns(df: DataFrame, pct: float = 50) -> DataFrame:
    """Drop the columns with strictly more than ``pct`` percent missing."""
    return drop_columns(df, sparse_columns(df, pct))


def apply_clip(df: DataFrame, bounds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Clip to known bounds; missing stays missing (least/greatest alone would fill it)."""
    new = {}
    for c, (lo, hi) in bounds.items():
        v = number(df, c)
        new[c] = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))
    return with_columns(df, new)


def clip_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = IQR_K) -> DataFrame:
    """Winsorise the given (default: all) numeric columns to their IQR bounds."""
    return apply_clip(df, iqr_bounds(df, list(cols or numeric_columns(df)), k))


def default_constant(df: DataFrame, column: str) -> object:
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return 0.0
    return "unknown" if isinstance(kind, T.StringType) else None


def learn_fills(df: DataFrame, methods: Mapping[str, str],
                constants: Mapping[str, object] | None = None) -> dict[str, object]:
    """The value each column's gaps will get; one job per kind of statistic."""
    wanted: dict[str, list[str]] = {m: [c for c, how in methods.items() if how == m] for m in METHODS}
    unknown = {m for m in methods.values()} - set(METHODS)
    if unknown:
        raise ValueError(f"unknown fill methods {sorted(unknown)}; use {METHODS}")
    numeric = set(numeric_columns(df))
    for c in wanted["median"] + wanted["mean"]:
        if c not in numeric:
            raise ValueError(f"'{c}' is not numeric; use mode or constant")
    fills: dict[str, object] = {c: q[0] for c, q in quantiles(df, wanted["median"], (0.5,)).items()}
    fills.update(agg_row(df, {c: F.avg(number(df, c)) for c in wanted["mean"]}))
    fills.update(modes(df, wanted["mode"]))
    for c in wanted["constant"]:
        fills[c] = (constants or {}).get(c, default_constant(df, c))
        if c in numeric and not isinstance(fills[c], (int, float)):
            raise ValueError(f"the constant for numeric '{c}' must be a number, not {fills[c]!r}")
    return {c: fills[c] for c in methods}


def apply_fills(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Fill gaps with known values. Whole-number columns stay so if the value is whole."""
    new = {}
    for c, value in fills.items():
        if value is None:                     # a column without any value has nothing to learn
            continue
        v, kind = present(df, c), df.schema[c].dataType
        if isinstance(kind, T.IntegralType) and float(value) != int(value):
            new[c] = F.coalesce(v.cast("double"), F.lit(float(value)))
        else:
            new[c] = F.coalesce(v, F.lit(value).cast(kind))
    return with_columns(df, new)


def fill_missing(df: DataFrame, methods: Mapping[str, str],
                 constants: Mapping[str, object] | None = None) -> DataFrame:
    """Fill gaps per column by 'median', 'mean', 'mode' or 'constant'."""
    return apply_fills(df, learn_fills(df, methods, constants))


def derive(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add (or replace) a column computed from an arithmetic formula."""
    return with_columns(df, {name: formula_column(df, formula)})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(present(df, target).isNotNull())


def null_target_rows(df: DataFrame, target: str) -> int:
    """How many rows ``drop_null_target`` drops."""
    return df.filter(present(df, target).isNull()).count()
