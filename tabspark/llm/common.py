"""Helpers that several operators of this subpackage share.

Results that are read more than once are written to the shared folder, not cached: a lost
executor then loses nothing, and row numbers given once stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabspark.session import scratch_path

#: White space between words: the six ASCII characters, and no others.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a written table may be broadcast; above, joins shuffle.
BROADCAST_ROWS = 100_000
#: The same for lookups of two or three numbers.
SLIM_ROWS = 500_000
#: Pieces into which the rows of one group are dealt for ranks and running sums.
SLICES = 1024
SALTS = 16
ROWS_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Groups above this give their memory back at once.
GROUP_BYTES = 1 << 20


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Whole texts make Arrow batches large: BATCH_ROWS rows a batch, unless the session was started with a number of its own."""
    if not spark.sparkContext.getConf().contains(ROWS_SETTING):
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers live on from task to task."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not that C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that gives its memory back when its task ends."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def roomy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same, and the worker first lets go of the tokenizers that another step left in it."""
    def wrapped(batches: Iterator) -> Iterator:
        from tabspark.llm.tokens import encoder
        if encoder.cache_info().currsize:
            encoder.cache_clear()
            release()
        yield from run(batches)
    return frugal(wrapped)


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group."""
    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes > GROUP_BYTES:
                release()
    return wrapped


def frugal_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups that meet."""
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            if left.nbytes + right.nbytes > GROUP_BYTES:
                release()
    return wrapped


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def modulo(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts).cast("bigint"))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with a written lookup table on keys that may be null or hot.

    The lookup is broadcast when its counted rows, and the elements of its arrays, are few. Otherwise its rows are
    repeated once a salt, and the hot keys of the left table are dealt over the salts.
    """
    arrays = [F.size(F.coalesce(c, F.array())) for c, t in right.dtypes if t.startswith("array")]
    names = [f"__{k}" for k in keys]
    right = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    cells = right.agg(F.coalesce(F.sum(sum(arrays, F.lit(1))), F.lit(0))).first()[0] if arrays else right.count()
    if cells <= rows:
        return left.join(F.broadcast(right), same, how).drop(*names)
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in left.dtypes if t in ("bigint", "int", "string")]), F.lit(SALTS)).cast("int"))
    right = right.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a written table is small on disk and large in the driver: its size there must not bring the broadcast back
    return left.join(right.hint("merge"), [*same, F.col("__salt") == F.col("__of")], how).drop(*names, "__salt", "__of")


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, str | Column],
            slices: int = SLICES) -> DataFrame:
    """Sums over the rows before each row of its group, groups of any size.

    ``sums`` names the new columns. The first of ``order`` is a whole number from 0 below ``slices``: a group's
    rows are summed by it first, the sums run over at most ``slices`` rows a group, and only the
    rows of one slice are sorted together. Without groups, this holds for the whole table.
    """
    values = {n: F.col(v) if isinstance(v, str) else v for n, v in sums.items()}
    df = df.withColumns({f"__v_{n}": v for n, v in values.items()} | {"__slice": order[0]})
    group = list(group) or []
    before = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*group, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    totals = totals.select(*group, "__slice", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values])
    inside = W.partitionBy(*group, "__slice").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    own = df.withColumns({f"__w_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    right = totals.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate([*group, "__slice"])], *[f"__b_{n}" for n in values])
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*group, "__slice"])]
    return own.join(right, same).select(*[c for c in df.columns if not c.startswith("__")],
                                        *[(F.col(f"__b_{n}") + F.col(f"__w_{n}")).alias(n) for n in values])


def ranged(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """The rows written in parts that follow each other in the order; the part is column ``part``."""
    parts = parts or spread(df.sparkSession)
    cols = [F.col(c).asc_nulls_last() for c in order]
    return stored(df.repartitionByRange(parts, *cols).withColumn("part", F.spark_partition_id()), name)
