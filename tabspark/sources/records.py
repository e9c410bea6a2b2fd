"""Records of CSV files whose quoted values hold line breaks, read by as many tasks as there are splits.

A line break ends a record where the quotes before it in the file are even in number. Within a split, each
task counts the quotes before every line; the counts of the splits before are one number for each split, and say whether the
split begins inside a value. Lines that are no record of their own are then put together, wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabspark.session import scratch_path

_LINES = "file string, split bigint, at bigint, line string, quotes bigint, odd boolean, even_start bigint, odd_start bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line the parity of the quotes before it in its split, and the last line up to it with an even and an odd number before it."""
    key, odd, last = None, 0, [None, None]
    for batch in batches:
        files, splits = (batch.column(c) for c in ("file", "split"))
        quotes = pc.fill_null(pc.count_substring(batch.column("line"), '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = batch.column("at").to_numpy(zero_copy_only=False)
        split = splits.to_numpy(zero_copy_only=False)
        name = files.dictionary_encode().indices.to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.concatenate([[True], (split[1:] != split[:-1]) | (name[1:] != name[:-1])])) if batch.num_rows else []
        before = np.zeros(batch.num_rows, np.int64)
        starts = [np.full(batch.num_rows, -1, np.int64) for _ in range(2)]
        for low, high in zip(edges, [*edges[1:], batch.num_rows]):
            now = (files[int(low)].as_py(), int(split[low]))
            if now != key:
                key, odd, last = now, 0, [-1, -1]
            count = odd + np.concatenate([[0], np.cumsum(quotes[low:high])])
            before[low:high] = count[:-1] % 2
            odd = int(count[-1] % 2)
            for parity in range(2):
                own = np.where(before[low:high] == parity, at[low:high], -1)
                starts[parity][low:high] = np.maximum.accumulate(np.concatenate([[last[parity]], own]))[1:]
                last[parity] = int(starts[parity][high - 1])
        found = [pa.array(s, pa.int64(), mask=s < 0) for s in starts]
        yield pa.record_batch([files, splits, batch.column("at"), batch.column("line"), pa.array(quotes), pa.array(before.astype(bool)), *found],
                              names=[c.split(" ")[0] for c in _LINES.split(", ")])


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, record): the records of the files under a path, header records included, without their last line break.

    ``split`` and ``at`` order the records of a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counted = lines.mapInArrow(_counted, _LINES)
    # one row a split: whether it begins inside a value, and where the record began that it goes on with
    per = counted.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.max("even_start").alias("even_start"), F.max("odd_start").alias("odd_start"))
    path = scratch_path(spark, "splits")
    per.write.parquet(path)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = spark.read.schema(per.schema).parquet(path).withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    start = F.when(F.col("inside"), F.col("odd_start")).otherwise(F.col("even_start"))
    known = known.withColumn("going", F.last(F.when(start.isNotNull(), F.struct("split", start.alias("at"))), ignorenulls=True).over(before))
    told = counted.join(known.select("file", "split", "inside", "going"), ["file", "split"])
    inside = F.col("odd") != F.col("inside")
    own = F.when(F.col("inside"), F.col("odd_start")).otherwise(F.col("even_start"))
    told = told.withColumns({"inside_value": inside, "first": F.coalesce(F.when(own.isNotNull(), F.struct("split", own.alias("at"))), F.col("going"))})
    whole = ~F.col("inside_value") & (F.col("quotes") % 2 == 0)
    alone = told.where(whole).select("file", "split", "at", F.col("line").alias("record"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("split", "at", "line"))), lambda x: x["line"])
    spread = told.where(~whole).groupBy("file", "first").agg(F.array_join(parts, "\n").alias("record"))
    spread = spread.select("file", F.col("first.split").alias("split"), F.col("first.at").alias("at"), "record")
    ended = F.when(F.col("record").endswith("\r"), F.expr("substr(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return alone.unionByName(spread).withColumn("record", ended)
