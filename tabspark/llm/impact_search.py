"""Exact best inner products through impact-ordered indexes.

Vectors are whole numbers. A block of candidates is an index: each dimension's postings are put
in segments by the quantised size of their value (its impact: one of ``LEVELS`` equal steps), sign kept. A search
takes the segments of all dimensions from the highest impact down and adds query weight times
quantised value to every member's accumulator, for a block of queries at once. After each impact it
knows how far any true score can still lie from its accumulator: what quantising took off the
segments seen, and what the largest value of the segments to come can add. A candidate whose
accumulator plus that bound stays under the k-th best accumulator minus the bound is proved out. The
search stops when the members that remain possible are few, or the segments are used up, and rescores all possible
members exactly. Every block of candidates meets every block of queries; both are of fixed size. Blocks of
candidates are dealt to a fixed number of groups, and the queries are sent once to each group.

Vectors that are null or hold null, NaN or infinite components take no part; shorter ones are
filled up with zeros; a query meets all rows with another id, repeated rows included; without
queries or candidates there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabspark.llm.common import ranged, running, spread, stored

TOP = 5
CANDIDATES = 8192
QUERIES = 512
#: Possible members for each query at which the search stops and rescores.
FEW = 64
LEVELS = 16
#: Impacts between two proofs.
PROOF = 4
SCALE = 256
#: Groups of blocks of candidates for each shuffle partition; queries are sent once to each group.
GROUPS = 4


class Index:
    """One block of candidates: for each impact, the quantised values of that segment, zero elsewhere."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        size = np.abs(vectors)
        step = max(1, -(-int(size.max(initial=0)) // levels))
        level = -(-size // step)  # (level - 1) * step < size <= level * step
        # sums of whole numbers below 2 ** 24 are exact in 32 bits
        self.kind = np.float32 if size.max(initial=0) < 512 and size.shape[1] <= 64 else np.float64
        self.segments, self.most, self.error = [], [], []
        for x in (int(x) for x in np.unique(level)[::-1] if x > 0):
            inside, middle = level == x, x * step - step // 2
            self.segments.append(np.where(inside, np.sign(vectors) * middle, 0).astype(self.kind).T.copy())
            self.most.append(np.where(inside, size, 0).max(axis=0))
            self.error.append(np.where(inside, np.abs(size - middle), 0).max(axis=0))


def search(index: Index, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top: int = TOP, few: int = FEW) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the ``top`` best of the block for each query."""
    weight, own = np.abs(queries).astype(np.float64), queries.astype(index.kind)
    if np.abs(queries).max(initial=0) >= 512:
        own = own.astype(np.float64)
    gathered = np.zeros((len(queries), len(ids)), own.dtype)
    other = query_ids[:, None] != ids[None, :]
    possible = other
    for k, segment in enumerate(index.segments, 1):
        gathered += own @ segment
        if k % PROOF and k < len(index.segments) or len(ids) <= top + 1:
            continue
        # in a dimension, a posting lies in one segment: seen with its error, or still to come
        seen = np.max(index.error[:k], axis=0)
        to_come = np.max(index.most[k:], axis=0) if k < len(index.segments) else 0
        slack = weight @ np.maximum(seen, to_come) + 0.5
        gathered[~other] = -np.inf
        best = np.partition(gathered, -top, axis=1)[:, -top]
        possible = gathered >= (best - 2 * slack)[:, None]
        if possible.sum() <= few * len(queries):
            break
    possible = possible & other
    out = []
    for i in range(len(queries)):
        member = np.flatnonzero(possible[i])
        exact = index.vectors[member] @ queries[i]
        order = np.lexsort((ids[member], -exact))[:top]
        out += [(int(query_ids[i]), int(ids[member[j]]), int(exact[j])) for j in order]
    return out


def _blocks(rows: DataFrame, size: int, name: str, order: str = "id") -> DataFrame:
    """Rows dealt to blocks of ``size`` in a row of the order, and each block as one row of arrays."""
    numbered = running(ranged(rows, [order], name), [], [F.col("part"), F.col(order)], {"at": F.lit(1).cast("bigint")})
    return numbered.groupBy(F.floor(F.col("at") / size).alias("block")).agg(F.collect_list(F.struct("id", "values")).alias("members"))


def nearest(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", every: int = 50, top: int = TOP,
            candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the best inner products of each row whose id divides by ``every``."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.col(vector).isNotNull() & F.col(id_).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_).cast("bigint").alias("id"), parts.alias("values"))
    rows = stored(rows, "vectors")
    right = stored(_blocks(rows, candidates, "candidates"), "candidate-blocks")
    left = stored(_blocks(rows.where(F.col("id") % every == 0), queries, "queries"), "query-blocks")
    # a task has some blocks of candidates, and every block of queries comes to it once
    groups = max(1, min(right.agg(F.count("block")).first()[0], GROUPS * spread(vectors.sparkSession)))
    right = right.select("block", "members", F.pmod("block", F.lit(groups)).cast("int").alias("group")).repartition(groups, "group")
    left = left.select(F.col("members").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).repartition(groups, "group")
    # repeated blocks of queries look small to the planner, which would send them all through the driver
    pairs = right.join(left.hint("merge"), "group")

    def matrix(members: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        values = members.field("values")
        ends = np.asarray(values.offsets)
        flat = np.asarray(values.values.to_numpy(zero_copy_only=False), np.int64)
        return np.asarray(members.field("id").to_numpy(zero_copy_only=False), np.int64), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def fitted(vs: list[np.ndarray], width: int) -> np.ndarray:
        return np.stack([np.pad(v[:width], (0, max(width - len(v), 0))) for v in vs])

    def find(batches):
        block, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if index is None or block != batch.column("block")[i].as_py():
                    block = batch.column("block")[i].as_py()
                    ids, members = matrix(batch.column("members").slice(i, 1).flatten())
                    width = max([1, *(len(v) for v in members)])
                    index = Index(fitted(members, width))
                query_ids, own = matrix(batch.column("queries").slice(i, 1).flatten())
                # where no candidate has a component, a query's counts for nothing
                found = search(index, ids, fitted(own, width), query_ids, top)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), (), ()))], names=["query_id", "vec_id", "score"])

    found = pairs.select("block", "queries", "members").mapInArrow(find, "query_id bigint, vec_id bigint, score bigint")
    # a query has ``top`` rows for each block of candidates
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
