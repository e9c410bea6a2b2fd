"""Ranked lexical search the other way round: the items wait in an index, the documents stream through it.

The items (the stated queries) are few beside the documents, so it is their terms that are indexed: a term's
postings name the items that hold it, and how often. Items are taken in blocks of bounded postings, and a block's index is
broadcast. Two passes follow:

1. Every whole text is cut into terms once. A document keeps its number of terms and, of the terms that any item
   holds, their counts; these counts are written, and the corpus figures (documents, terms, documents of a term) summed from them.
2. Each document's counts stream through the index of a block: a term's postings spread its weight over the items that
   hold it. Each item has a heap of its ``top`` best documents so far, and a task keeps no more than the heaps.
   The heaps of all tasks are merged in two steps, first by item and salt.

Nothing is left out: every document meets every item that shares a term with it. Sums are 64-bit integers.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A null or empty
text has none: as a document it does not count, as an item it finds nothing. Repeated rows are documents, or items, of their
own. Equal scores go by doc_id, a null doc_id last. Rows of an item table keep all their columns in ``item``. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tabspark.llm.common import stored
from tabspark.llm.texts import parts

#: Postings (item, term) and bytes of terms that a block of items holds at most; a single larger item is a block of its own.
POSTINGS, TERM_BYTES = 400_000, 8 << 20
#: Scores held at once: items of a block times documents of a slice.
CELLS = 4_000_000
#: Heaps of one item that are merged together first.
SALTS = 256

_LETTER = np.zeros(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _LETTER[_low:_high + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = np.iinfo(np.int64).max


def terms(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The terms of all texts in a row, and where each text's begin."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = np.concatenate([[False], _LETTER[data], [False]])
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    moved = np.concatenate([[0], np.cumsum(inside[1:-1])])
    found = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(np.concatenate([moved[start], moved[-1:]]).astype(np.int64)),
        pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside[1:-1]]])))
    return found, np.searchsorted(start, offsets)


def counts(batch: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of terms, and as (text, term, times) the counts of known terms."""
    found, begin = terms(batch.column("text"))
    coded = found.dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(batch.num_rows), np.diff(begin))
    key, times = np.unique((text * len(known) + codes)[codes >= 0], return_counts=True)
    return np.diff(begin), key // max(len(known), 1), key % max(len(known), 1), times


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item, number, term, times): a row for each term of each item; items are numbered from 0 and written once."""
    rows = stored(items.select(F.struct(*items.columns).alias("item"), F.col(text).alias("text"),
                               F.monotonically_increasing_id().alias("number")), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found, begin = terms(batch.column("text"))
            coded = found.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            text = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            key, times = np.unique(text * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            yield pa.record_batch([batch.column("number").take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)).cast(pa.string()),
                                   pa.array(times, pa.int64())], names=["number", "term", "times"])

    held = rows.select("number", "text").mapInArrow(cut, "number bigint, term string, times bigint")
    return stored(rows.select("item", "number").join(held, "number", "left"), "item-terms")


def _blocks(held: DataFrame, postings: int) -> list[tuple[int, int]]:
    """Ranges of item numbers that hold at most so many postings and bytes of terms."""
    size = F.greatest(F.count("term") / F.lit(float(postings)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)) / F.lit(float(TERM_BYTES)))
    sizes = held.groupBy("number").agg(size.alias("share")).where("share > 0")
    edges, low, filled = [], None, 0.0
    for number, share in sizes.orderBy("number").toLocalIterator():
        if low is None or filled + share > 1:
            if low is not None:
                edges.append((low, number))
            low, filled = number, 0.0
        filled += share
    return [*edges, (low, _NONE)] if low is not None else []


def document_counts(docs: DataFrame, held: DataFrame, blocks: list[tuple[int, int]], key: str, text: str) -> list[DataFrame]:
    """For each block of items: (doc_id, n, terms, times), the block's terms by their place in code-point order."""
    spark = docs.sparkSession
    found = []
    for low, high in blocks:
        known = _vocabulary(held, low, high)
        words = spark.sparkContext.broadcast(known)

        def count(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            known = pa.array(words.value, pa.large_string())
            for batch in parts(batches):
                n, text, term, times = counts(batch, known)
                ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, times)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

        rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        found.append(stored(rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, times array<int>").where("n > 0"), "counts"))
    return found


def _vocabulary(held: DataFrame, low: int, high: int) -> list[str]:
    block = held.where((F.col("number") >= low) & (F.col("number") < high) & F.col("term").isNotNull())
    return sorted(r[0] for r in block.select("term").distinct().toLocalIterator())


def heap(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best of an item's heap and of further documents: highest score, then smallest doc_id."""
    if len(best[0]) == top:
        may = score >= best[0][-1]
        score, doc = score[may], doc[may]
    if len(score) > 4 * top:
        # the documents at or above the top-th score, ties included
        may = score >= np.partition(score, len(score) - top)[len(score) - top]
        score, doc = score[may], doc[may]
    score, doc = np.concatenate([best[0], score]), np.concatenate([best[1], doc])
    order = np.lexsort((doc, -score))[:top]
    return score[order], doc[order]


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text",
           top: int = 10, postings: int = POSTINGS) -> DataFrame:
    """(item, number, rank, doc_id, score): the best documents of each item row, by falling score."""
    spark: SparkSession = docs.sparkSession
    held = item_terms(items, item_text)
    blocks = _blocks(held, postings)
    best = None
    for (low, high), counted in zip(blocks, document_counts(docs, held, blocks, key, text)):
        found = _block(spark, held, low, high, counted, top)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint, part int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = W.partitionBy("number", F.col("part") % SALTS).orderBy(*order)
    whole = W.partitionBy("number").orderBy(*order)
    best = best.withColumn("place", F.row_number().over(some)).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    named = held.groupBy("number").agg(F.any_value("item").alias("item"))
    return best.select("number", "rank", "doc_id", "score").join(named, "number").select("item", "number", "rank", "doc_id", "score")


def _block(spark: SparkSession, held: DataFrame, low: int, high: int, counted: DataFrame, top: int) -> DataFrame:
    """(number, doc_id, score, part): the heaps of each task for the items of a block."""
    words = _vocabulary(held, low, high)
    place = {t: i for i, t in enumerate(words)}
    # corpus figures: documents with a term, all their terms, and of each term of the block how many documents hold it
    total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for term, number in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[term] = number
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rows = held.where((F.col("number") >= low) & (F.col("number") < high) & F.col("term").isNotNull()).select("number", "term", "times")
    postings = sorted((place[r["term"]], r["number"], r["times"]) for r in rows.toLocalIterator())
    numbers = sorted({n for _, n, _ in postings})
    of = {n: i for i, n in enumerate(numbers)}
    begin = np.searchsorted(np.array([p for p, _, _ in postings]), np.arange(len(words) + 1))
    index = spark.sparkContext.broadcast((
        np.array(numbers, np.int64), begin, np.array([of[n] for _, n, _ in postings], np.int64),
        np.array([t * int(weight[p]) for p, _, t in postings], np.int64), int(total[0]), int(total[1])))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        numbers, begin, item, gain, n_docs, n_terms = index.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(numbers)
        width = max(CELLS // max(len(numbers), 1), 1)
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                doc = pc.fill_null(batch.column("doc_id"), _NONE).to_numpy(zero_copy_only=False).astype(np.int64)
                scores = _scores(batch, begin, item, gain, len(numbers), n_docs, n_terms)
                for i in np.flatnonzero(scores.any(1)).tolist():
                    hits = np.flatnonzero(scores[i] > 0)
                    heaps[i] = heap(heaps[i], scores[i][hits], doc[hits], top)
        sizes = [len(s) for s, _ in heaps]
        if sum(sizes):
            doc = np.concatenate([d for _, d in heaps])
            yield pa.record_batch([
                pa.array(np.repeat(numbers, sizes), pa.int64()), pa.array(doc, pa.int64(), mask=doc == _NONE),
                pa.array(np.concatenate([s for s, _ in heaps]), pa.int64()),
                pa.array(np.full(sum(sizes), TaskContext.get().partitionId()), pa.int32())], names=["number", "doc_id", "score", "part"])

    return counted.mapInArrow(stream, "number bigint, doc_id bigint, score bigint, part int")


def _scores(batch: pa.RecordBatch, begin: np.ndarray, item: np.ndarray, gain: np.ndarray, items: int, n_docs: int, n_terms: int) -> np.ndarray:
    """Items x documents: the sums of the documents' terms spread over the postings."""
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    short = 25 + np.array([75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    lists = batch.column("terms")
    ends = np.asarray(lists.offsets)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    part = 1_000_000_000 * times // (1000 * times + 8 * short[doc])
    out = np.zeros(items * batch.num_rows, np.int64)
    step = 2_000_000  # postings met at once
    lengths = begin[term + 1] - begin[term]
    reach = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(term):
        high = max(int(np.searchsorted(reach, reach[low] + step, side="right")) - 1, low + 1)
        size = lengths[low:high]
        own = np.repeat(np.arange(low, high), size)
        at = np.arange(len(own)) - np.repeat(reach[low:high] - reach[low], size) + begin[term[own]]
        np.add.at(out, item[at] * batch.num_rows + doc[own], gain[at] * part[own])
        low = high
    return out.reshape(items, batch.num_rows)
