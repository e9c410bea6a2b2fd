"""Column typing and the small expression helpers every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class ColumnKinds:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    ignored: tuple[str, ...]


def classify_columns(schema: T.StructType) -> ColumnKinds:
    """Sort columns into numeric, categorical (string, boolean) and ignored (all else)."""
    numeric, categorical, ignored = [], [], []
    for field in schema.fields:
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            categorical.append(field.name)
        else:
            ignored.append(field.name)
    return ColumnKinds(tuple(numeric), tuple(categorical), tuple(ignored))


def numeric_columns(df: DataFrame) -> list[str]:
    return list(classify_columns(df.schema).numeric)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by literal name (dots and backticks in CSV headers are not paths)."""
    return F.col(quote(name))


def _is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    if _is_float(df.schema[name].dataType):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL once, at scan, so later operators test one kind of missing."""
    if not any(_is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select([present(df, f.name).alias(f.name) for f in df.schema.fields])


def half_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of numpy and pandas, bit for bit."""
    return F.rint(value * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole * 100, rounded; NULL on an empty table."""
    return half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)] or [[]]


def agg_row(df: DataFrame, exprs: dict[str, Column], chunk: int = 200) -> dict:
    """Global aggregates as a dict; very wide requests are cut so codegen stays within limits."""
    out: dict = {}
    for part in chunks(list(exprs.items()), chunk):
        if part:
            names = [f"a{i}" for i in range(len(part))]
            row = df.agg(*[e.alias(n) for n, (_, e) in zip(names, part)]).first()
            out.update({key: row[n] for n, (key, _) in zip(names, part)})
    return out


def stack_rows(wide: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """Turn one wide aggregate row into a long table: one output row per struct."""
    return wide.select(F.inline(F.array(*[F.struct(*r) for r in rows])))
