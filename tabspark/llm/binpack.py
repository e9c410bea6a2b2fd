"""Shards of near-equal bytes from indivisible groups, by best-fit decreasing.

Documents of equal text form a group that stays together. Groups of at least one parcel's
size stand for themselves; smaller ones are laid out by the hash of their text and cut, between
groups, into parcels. Both are at most ``shards * grain`` in number, whatever the table's
size, so they are packed on the driver: by falling size, each into the fullest shard that still
holds it, found in a sorted list of remaining capacities. The capacity is the smallest (to
one part in 100,000) with which no more than the wanted shards are needed; a group above the
mean gets a shard of its own. Rows find their shard by two sorted lookups of bounded size.

A null text has no bytes (size 16, crc32 0); null and empty texts are two groups; repeated
rows each get a slot; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabspark.llm.common import SLICES, running, stored

SHARDS = 40
GRAIN = 1000
OVERHEAD = 16


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item, taken in the given order; None when more than ``most`` bins are needed."""
    open_bins: list[tuple[int, int]] = []  # (remaining, bin), sorted
    placed, bins = [], 0
    for size in sizes:
        k = bisect_left(open_bins, (size, -1))
        if k == len(open_bins):
            if bins == most:
                return None
            remaining, at, bins = capacity, bins, bins + 1
        else:
            remaining, at = open_bins.pop(k)
        insort(open_bins, (remaining - size, at))
        placed.append(at)
    return placed


def even_bins(sizes: list[int], bins: int) -> list[int]:
    """The bin of each item, in ``bins`` bins as even as best-fit decreasing makes them."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    placed, at, rest = [0] * len(sizes), 0, sum(sizes)
    while order and bins - at > 1 and sizes[order[0]] * (bins - at) > rest:
        placed[order[0]] = at
        rest, at = rest - sizes[order[0]], at + 1
        order = order[1:]
    if not order:
        return placed
    falling, left = [sizes[i] for i in order], bins - at
    low, high = max(falling[0], -(-rest // left)), max(2 * falling[0], -(-2 * rest // left))
    found = best_fit(falling, low, left)
    if found is None:
        found = best_fit(falling, high, left)
        while high - low > max(1, rest // left // 100_000):
            middle = (low + high) // 2
            if (tried := best_fit(falling, middle, left)) is None:
                low = middle
            else:
                high, found = middle, tried
    for i, b in zip(order, found):
        placed[i] = at + b
    return placed


def shard(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """``keep`` of each row with its size, text_crc32, shard and gapless slot in the shard."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(docs.select(
        F.struct(*keep).alias("row"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text), F.col(text).isNull()).alias("group"), F.xxhash64(F.lit("slot"), *keep).alias("turn")), "sizes")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit = max(1, -(-total // (shards * grain)))
    large = groups.where(F.col("bytes") >= unit).orderBy("group").toPandas()  # at most shards * grain rows
    slice_ = (F.shiftright("group", 54) + 512).cast("bigint")
    laid = running(groups.where(F.col("bytes") < unit), [], [slice_, F.col("group")], {"before": "bytes"})
    parcels = laid.groupBy(F.floor(F.col("before") / unit).alias("parcel")).agg(
        F.min("group").alias("first"), F.sum("bytes").alias("bytes")).orderBy("first").toPandas()  # no more than that and one
    bins = np.array(even_bins([int(x) for x in [*large["bytes"], *parcels["bytes"]]], shards), np.int32)
    keys, edges = large["group"].to_numpy(np.int64), parcels["first"].to_numpy(np.int64)
    of_large, of_parcel = bins[:len(keys)], bins[len(keys):]

    @F.pandas_udf("int")
    def find(group: pd.Series) -> pd.Series:
        hashes = group.to_numpy(np.int64)
        out = np.zeros(len(hashes), np.int32)
        if len(edges):
            out = of_parcel[np.maximum(np.searchsorted(edges, hashes, side="right") - 1, 0)]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out = np.where(keys[at] == hashes, of_large[at], out)
        return pd.Series(out)

    placed = rows.withColumn("shard", find("group"))
    return running(placed, ["shard"], [F.pmod("turn", F.lit(SLICES)), F.col("turn")], {"slot": F.lit(1).cast("bigint")}).drop("turn", "group")
