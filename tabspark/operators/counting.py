"""Counts of distinct values for many columns in one shuffle: modes, domains, dictionaries.

Rows are unpivoted to (column, value) pairs and pre-aggregated before the shuffle, so a value
that holds a third of the table reaches the reducer as one row per map task, and no column's
set of values is ever gathered in one buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabspark.functions.columns import agg_row, chunks, half_even, present


def value_counts_long(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(c, v0, v1, ..., n): one row per column position and distinct present value.

    There is one value field per data type among the columns; the fields of other types are
    NULL. Returns the frame and, per column, the field that holds its values.
    """
    types = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in cols))
    fields = [f"v{types.index(df.schema[c].dataType.simpleString())}" for c in cols]
    pairs = []
    for i, c in enumerate(cols):
        value = present(df, c)
        cells = [(value if f"v{t}" == fields[i] else F.lit(None).cast(name)).alias(f"v{t}")
                 for t, name in enumerate(types)]
        pairs.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("c"), *cells)))
    keys = ["c"] + [f"v{t}" for t in range(len(types))]
    long = df.select(F.inline(F.array_compact(F.array(*pairs))))
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), fields


def _modes(counted: DataFrame, fields: list[str], cols: Sequence[str]) -> dict[str, object]:
    values = [c for c in counted.columns if c not in ("c", "n")]
    best = counted.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), *values)).alias("best")).collect()
    found = {row["c"]: row["best"] for row in best}       # one row per column
    return {c: found[i][fields[i]] if i in found else None for i, c in enumerate(cols)}


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent present value per column; ties go to the smallest value."""
    out: dict[str, object] = {}
    for part in chunks(list(cols), 50):
        if part:
            counted, fields = value_counts_long(df, part)
            out.update(_modes(counted, fields, part))
    return out


def distinct_at_most(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int | None]:
    """Exact number of distinct values where it is at most ``limit``, else ``None``.

    A first pass estimates all columns with small sketches. With few distinct values such a
    sketch counts linearly and cannot report several times the truth, so dropping columns
    estimated far above the limit is safe; the others are counted exactly.
    """
    if not cols:
        return {}
    rough = agg_row(df, {c: F.approx_count_distinct(present(df, c)) for c in cols})
    near = [c for c in cols if rough[c] <= 4 * limit + 50]
    exact: dict[str, int] = {}
    for part in chunks(near, 50):
        if part:
            counted, _ = value_counts_long(df, part)
            exact.update({part[c]: n for c, n in counted.groupBy("c").count().collect()})
    return {c: (exact.get(c, 0) if exact.get(c, 0) <= limit else None) if c in near else None for c in cols}


def domains(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list | None]:
    """Sorted distinct values of the columns that have at most ``limit`` of them."""
    sizes = distinct_at_most(df, cols, limit)
    small = [c for c in cols if sizes[c] is not None]
    out: dict[str, list | None] = {c: None for c in cols}
    for part in chunks(small, 50):
        if part:
            out.update({c: [] for c in part})
            counted, fields = value_counts_long(df, part)
            for row in counted.drop("n").collect():        # at most `limit` rows per column
                out[part[row["c"]]].append(row[fields[row["c"]]])
    return {c: sorted(v) if v is not None else None for c, v in out.items()}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct): distribution of one column, most frequent first; missing is not counted."""
    values = df.select(present(df, column).alias("value")).filter("value is not null")
    total = values.count()
    return (values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", half_even(F.col("n") / F.lit(float(total)) * 100, 1))
            .orderBy(F.desc("n"), "value"))
