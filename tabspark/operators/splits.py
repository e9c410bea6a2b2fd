"""Deterministic splits. Every split is a function of the row's key hash, so it does not
depend on partitioning and a retried task gives the same rows the same side.

Rows of one key stay together in every split. Without ``key`` the whole row is hashed and equal rows land
on the same side, except in the exact splits, which deal copies out one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.functions.columns import col, quote
from tabspark.functions.hashing import BUCKETS, bucket, row_hash

SLICES = 4096              # slices of the hash range in which units are ranked


def _salt(purpose: str, seed: int) -> str:
    return str(seed) if purpose == "holdout" else f"{purpose}{seed}"


def holdout(df: DataFrame, test_share: float = 0.2, seed: int = 42, key: Sequence[str] | None = None,
            exact: bool = False) -> DataFrame:
    """Adds ``is_test``. By default each row is tested with the given probability; ``exact``
    takes ceil(share * rows) rows, as a shuffled split does; with repeated keys, whole keys until so
    many rows are reached."""
    if exact:
        n = df.count()
        ranked = hash_rank(df, [], _salt("holdout", seed), key)
        size = -(-n * round(test_share * BUCKETS) // BUCKETS)
        return ranked.withColumn("is_test", F.col("_ahead") < size).drop("_rank", "_ahead")
    return df.withColumn("is_test", bucket(df, key, _salt("holdout", seed)) < round(test_share * BUCKETS))


def three_way(df: DataFrame, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Adds ``part``: 80 % train, and the remaining 20 % halved into val and test."""
    b = bucket(df, key, _salt("holdout", seed))
    return df.withColumn("part", F.when(b < 1000, "val").when(b < 2000, "test").otherwise("train"))


def kfold(df: DataFrame, k: int = 5, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Adds ``fold`` in 0..k-1."""
    if k < 2:
        raise ValueError("k must be at least 2")
    return df.withColumn("fold", bucket(df, key, _salt("fold", seed), k).cast("int"))


def stratified_kfold(df: DataFrame, k: int, label: str, seed: int = 42,
                     key: Sequence[str] | None = None) -> DataFrame:
    """Adds ``fold`` so that every class is dealt evenly: its fold sizes differ by at most 1.

    With repeated keys, the keys of each class are dealt evenly, and all rows of a key share its fold; a
    key's class is its most frequent label, the smallest of equally frequent ones.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = hash_rank(df, [label], _salt("fold", seed), key)
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "_ahead")


def prefix_sample(df: DataFrame, share: float, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """A share of the rows; smaller shares are subsets of larger ones. Its hash is
    independent of the fold and hold-out hashes."""
    return df.filter(prefix_bucket(df, seed, key) < round(share * BUCKETS))


def prefix_bucket(df: DataFrame, seed: int = 42, key: Sequence[str] | None = None) -> Column:
    return bucket(df, key, _salt("prefix", seed))


def hash_rank(df: DataFrame, by: Sequence[str], salt: str, key: Sequence[str] | None = None) -> DataFrame:
    """Adds ``_rank``, 0, 1, 2, ... in hash order within each ``by`` group, and ``_ahead``, the rows before.

    What is ranked are units: keys, or without a key distinct rows with their number of copies. Equal rows
    and keys collapse before the shuffle, so no hot one is sorted. Units are ranked in slices of the hash
    range; the sizes of the slices give each its start. Neither the table's size nor its partitioning matter.
    """
    names, cols = list(by), list(key) if key else df.columns
    if key and names:
        counted = df.groupBy(*[col(c) for c in dict.fromkeys([*cols, *names])]).agg(F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("_m"), *[col(c) for c in names]))
        units = counted.groupBy(*[col(c) for c in cols]).agg(F.sum("_n").alias("_n"), best.alias("_best"))
        units = units.select(*[col(c) for c in cols], "_n", *[F.col("_best").getField(c).alias(f"_by{i}") for i, c in enumerate(names)])
    else:
        units = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
        units = units.select("*", *[col(c).alias(f"_by{i}") for i, c in enumerate(names)])
    group = [f"_by{i}" for i in range(len(names))]
    units = units.withColumn("_h", row_hash(units, cols, salt))
    units = units.withColumn("_slice", F.floor(F.col("_h") / F.lit(2 ** 32 // SLICES)))
    sizes = units.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_units"), F.sum("_n").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)   # SLICES rows at most
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_slice").alias("_of"),
                          F.coalesce(F.sum("_units").over(before), F.lit(0)).alias("_units"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"))
    within = Window.partitionBy(*group, "_slice").orderBy("_h", *[col(c).cast("string") for c in cols])
    placed = units.withColumn("_i", F.row_number().over(within) - 1).withColumn(
        "_r", F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_slice") == F.col("_of")]
    placed = placed.join(starts, same).withColumn("_ahead", F.col("_rows") + F.col("_r"))
    if not key:
        copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
        rank = F.col("_ahead") + F.col("_copy")
        return copies.select(*[col(c) for c in df.columns], rank.alias("_rank"), rank.alias("_ahead"))
    found = placed.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(cols)], (F.col("_units") + F.col("_i")).alias("_rank"), "_ahead")
    return df.join(found, [df[quote(c)].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate(cols)]).select(
        *[col(c) for c in df.columns], "_rank", "_ahead")
