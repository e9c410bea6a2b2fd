"""Deterministic row hashes: the only source of randomness in splits.

A hash of the key does not change with partitioning, retries or lost executors,
unlike ``randomSplit`` or ``rand``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabspark.functions.columns import col

BUCKETS = 10_000
#: What stands for a missing value in the hashed text, so that (NULL, 'a') and ('a', NULL) are not the same row.
MISSING = "\x00"


def row_hash(df: DataFrame, key: Sequence[str] | None, salt: str) -> Column:
    """Uniform 32-bit hash of the key columns (of the whole row when no key is given)."""
    names = list(key) if key else df.columns
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(col(c).cast("string"), F.lit(MISSING)) for c in names])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def bucket(df: DataFrame, key: Sequence[str] | None, salt: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(row_hash(df, key, salt), F.lit(buckets).cast("bigint"))
