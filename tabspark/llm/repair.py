"""Token ids stored as Re-Pair grammars that can be read at any place.

Texts are dealt to shards that follow each other by doc_id, and a shard is written in blocks of
whole documents. In a block, the frequent pairs of neighbouring ids are replaced by new
symbols, again and again: a round counts all pairs and takes the most frequent ones that
cannot overlap, so it equals replacing them one by one. The file keeps the rules, the length each
rule expands to, the remaining symbols, and where each document begins among them. A document, or
any stretch of it, is decoded from its own symbols alone.

A file is Parquet, a row for each block: (part, block, ids before it in its part, doc_ids, grammar).
The grammar is little-endian: seven unsigned 32-bit numbers (magic, first symbol, documents, rules, symbols,
ids, width of a symbol in bytes); the rules as pairs and their expansion lengths, 32 bits each; where
documents begin among the symbols, 32 bits each; the symbols.

A null text is empty (its end id alone); a null doc_id comes last; repeated rows are documents
of their own; an empty table gives a file without blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabspark.llm.common import spread
from tabspark.llm.tokens import encoder
from tabspark.session import scratch_path

END = 2
MAGIC = 0x52505231
#: Ids that start a new block once reached; one long document can make a block longer.
BLOCK_PIECES = 1 << 18
#: A pair must be found this often in a block to be replaced.
LEAST = 8
ROUNDS = 6
#: Rules of one round; all symbols of a block stay below 65,536.
ROUND_RULES = 2048
SYMBOLS = 1 << 16


def compress(ids: np.ndarray, begin: np.ndarray, first: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs), symbols, and where documents begin among the symbols.

    No pair holds the end id, so none reaches over the end of a document.
    """
    seq, starts, rules = ids.astype(np.uint32), begin.astype(np.int64), np.zeros((0, 2), np.uint32)
    for _ in range(ROUNDS):
        free = min(ROUND_RULES, SYMBOLS - first - len(rules))
        if len(seq) < 2 or free <= 0 or first >= SYMBOLS:
            break
        keys = (seq[:-1] << np.uint32(16)) | seq[1:]
        # no end id on either side, and no pair of twins, whose copies would overlap
        good = (seq[:-1] != end) & (seq[1:] != end) & (seq[:-1] != seq[1:])
        ordered = np.sort(keys[good])
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= LEAST)
        if not len(often):
            break
        often = often[np.lexsort((ordered[edges[often]], -counts[often]))][:free]
        lefts, rights, chosen = set(), set(), []
        for key in ordered[edges[often]].tolist():
            a, b = key >> 16, key & 0xFFFF
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                chosen.append(key)
        picked = np.sort(np.array(chosen, np.uint32))
        # no symbol is both a left and a right one, so twins and pairs with the end id fall out here
        begins, closes = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        begins[list(lefts)] = closes[list(rights)] = True
        at = np.flatnonzero(begins[seq[:-1]] & closes[seq[1:]])
        where = np.minimum(np.searchsorted(picked, keys[at]), len(picked) - 1)
        hit = picked[where] == keys[at]
        at, where = at[hit], where[hit]
        seq[at] = first + len(rules) + where
        starts = starts - np.searchsorted(at, starts - 1)
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        rules = np.concatenate([rules, np.stack([picked >> np.uint32(16), picked & np.uint32(0xFFFF)], 1)])
    return rules, seq, starts


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only names ids and earlier rules."""
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def pack_block(ids: np.ndarray, begin: np.ndarray, first: int) -> bytes:
    rules, seq, starts = compress(ids, begin, first)
    width = 2 if first <= SYMBOLS else 4
    head = np.array([MAGIC, first, len(begin) - 1, len(rules), len(seq), len(ids), width], "<u4")
    return b"".join([head.tobytes(), rules.astype("<u4").tobytes(), lengths_of(rules, first).astype("<u4").tobytes(),
                     starts.astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Block:
    """A grammar that is read."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<u4", 7)
        if head[0] != MAGIC:
            raise ValueError("not a Re-Pair block")
        _, self.first, self.documents, n, symbols, self.n_ids, width = (int(x) for x in head)
        at = 28
        self.rules = np.frombuffer(raw, "<u4", 2 * n, at).reshape(n, 2)
        self.lengths = np.frombuffer(raw, "<u4", n, at + 8 * n).astype(np.int64)
        at += 12 * n
        self.starts = np.frombuffer(raw, "<u4", self.documents + 1, at).astype(np.int64)
        self.symbols = np.frombuffer(raw, f"<u{width}", symbols, at + 4 * (self.documents + 1)).astype(np.uint32)
        # every rule's expansion in one array
        self.where = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.zeros(int(self.where[-1]), np.uint32)
        for i, (a, b) in enumerate(self.rules.tolist()):
            low = int(self.where[i])
            middle = low + self.size_of(a)
            self.flat[low:middle] = a if a < self.first else self.flat[self.where[a - self.first]:self.where[a - self.first + 1]]
            self.flat[middle:self.where[i + 1]] = b if b < self.first else self.flat[self.where[b - self.first]:self.where[b - self.first + 1]]

    def size_of(self, symbol: int) -> int:
        return 1 if symbol < self.first else int(self.lengths[symbol - self.first])

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.sizes(symbols)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(symbols, size)
        rule = np.flatnonzero(symbols >= self.first)
        if len(rule):
            n = size[rule]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(ends[rule], n) + inside] = self.flat[np.repeat(self.where[symbols[rule] - self.first], n) + inside]
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document: only symbols that reach into them are expanded."""
        own = self.symbols[self.starts[k]:self.starts[k + 1]]
        ends = np.cumsum(self.sizes(own))
        stop = int(ends[-1]) if stop is None else stop
        low, high = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(own[low:high])[start - before:stop - before]


def write_ids(docs: DataFrame, tokenizer: str, path: str, first: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Write all texts' ids, in ascending order of the key, as grammars under ``path``.

    ``first`` is the number of ids the tokenizer has: symbols from it on are rules.
    """
    def encode(batches):
        before, blocks = 0, 0
        for batch in batches:
            keys, part = batch.column("key"), batch.column("part")[0].as_py() if batch.num_rows else 0
            for low, high, ids, begin in encoder(tokenizer, False).ids(batch.column("text"), END, BLOCK_PIECES):
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blocks], pa.int32()), pa.array([before], pa.int64()),
                                       pa.array([len(ids)], pa.int64()), pa.array([keys.slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                                       pa.array([pack_block(ids, begin, first)], pa.binary())],
                                      names=["part", "block", "before", "n_ids", "doc_ids", "grammar"])
                before, blocks = before + len(ids), blocks + 1

    order = F.col("key").asc_nulls_last()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts or spread(docs.sparkSession), order).sortWithinPartitions(order, "text")
    rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        encode, "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, grammar binary").write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.schema("part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, grammar binary").parquet(path)
    # one row a part; parts are as many as the shuffle's, whatever the documents
    offsets = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        F.col("part").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))

    def decode(batches):
        for batch in batches:
            for first, keys, raw in zip(batch.column("first").to_pylist(), batch.column("doc_ids"), batch.column("grammar")):
                block = Block(raw.as_py())
                ids = np.ascontiguousarray(block.expand(block.symbols), "<u4")
                ends = np.concatenate([[0], np.cumsum(block.sizes(block.symbols))])[block.starts]
                view = memoryview(ids).cast("B")
                yield pa.record_batch([keys.values, pa.array(first + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int64()),
                                       pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(offsets), F.col("part") == F.col("of")).select(
        (F.col("ahead") + F.col("before")).alias("first"), "doc_ids", "grammar")
    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file(docs: DataFrame, tokenizer: str, first: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids to the shared folder and report on them from there."""
    path = scratch_path(docs.sparkSession, "repair")
    write_ids(docs, tokenizer, path, first, key, text)
    return read_ids(docs.sparkSession, path)
