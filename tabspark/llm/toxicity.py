"""Toxic documents and the sentences that make them so, learned from document labels alone.

A document is a bag of sentences. Each sentence gets a logistic score from its words, and the
document's score is their noisy-or: one minus the product of what each leaves. The likelihood of
the document labels is maximised over the word weights (Adam on the whole sample, L2), so
the weights settle on the words whose sentences explain the labels, and the same sentence scores then
say where the offence is.

Sentences end at . ! ? or a line break, and after ``LONGEST`` words. A word counts once in a sentence.
Its weight is the sum of those of its features: the word itself without letter case and outer
marks, and its first four bytes, so that inflected forms of a known insult are met too. The fit uses a bounded sample: at most ``SAMPLE`` labelled documents,
those with the smallest hashes of their ids, none longer than ``SAMPLE_CHARS`` characters. A feature has a weight
if it is in ``LEAST_DOCS`` of them and in toxic ones by ``LEAST_Z`` deviations more than chance has it. Scoring reads every whole text.

An empty or null text is one sentence without words. Without any label, or with labels of one
kind only, every score is their share of toxic ones (0 without any). A document labelled
twice counts as toxic if half of its labels say so. Repeated rows score alike.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabspark.llm.texts import PART_BYTES, Words, hashes, parts, split_words

SAMPLE = 8000
SAMPLE_CHARS = 40_000
LEAST_DOCS = 5
LEAST_Z = 3.0
LONGEST = 64
PREFIX = 4
STEPS = 200
#: Documents of the sample that are split into words at a time.
CHUNK = 500
RATE = 0.1
L2 = 1e-3
OUTER = ".,;:!?\"'()[]{}<>|*_-#"


class Model(NamedTuple):
    """Sorted word hashes, their weights, the weight of every sentence; or one score for all."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


class Bags(NamedTuple):
    """Distinct words of sentences: ``owner`` names the sentence of each ``word``; document i has sentences first[i] to first[i + 1]."""

    owner: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    first: np.ndarray


def sentences(words: Words) -> Bags:
    """The sentences of all texts in a row; a text without words has none."""
    ends = pc.match_substring_regex(words.distinct, r"[.!?][\"')\]]*$").to_numpy(zero_copy_only=False)
    n = len(words.codes)
    first = np.zeros(n, bool)
    first[words.begin[:-1][words.begin[:-1] < words.begin[1:]]] = True
    if n:
        first[1:] |= ends[words.codes[:-1]]
        first |= words.newline
        at = np.flatnonzero(first)
        first |= (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))) % LONGEST == 0
    begin = np.flatnonzero(first)
    pairs = np.sort((np.cumsum(first) - 1) << 32 | words.codes)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if n else pairs
    return Bags(pairs >> 32, pairs & 0xFFFFFFFF, begin, np.searchsorted(begin, words.begin))


def features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of the distinct words; a word of marks alone has none."""
    plain = pc.utf8_lower(pc.utf8_trim(distinct.cast(pa.large_string()), OUTER))
    some = np.flatnonzero(pc.not_equal(plain, "").to_numpy(zero_copy_only=False))
    plain = plain.take(pa.array(some))
    whole = hashes(plain) >> np.uint64(8) | np.uint64(1 << 56)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[:len(some) + 1] if len(some) else np.zeros(1, np.int64)
    data = np.append(np.frombuffer(plain.buffers()[2] or b"", np.uint8), np.zeros(PREFIX, np.uint8)).astype(np.uint64) if len(some) else np.zeros(PREFIX, np.uint64)
    start = np.zeros(len(some), np.uint64)
    for k in range(PREFIX):
        start |= np.where(offsets[:-1] + k < offsets[1:], data[offsets[:-1] + k], np.uint64(0)) << np.uint64(8 * k)
    return np.concatenate([some, some]), np.concatenate([whole, start])


def _or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log of what all sentences leave, for each document; every document has a sentence."""
    return np.add.reduceat(-np.logaddexp(0, logits), first)


def _by_word(own: np.ndarray, code: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs in word order, and where each word's begin."""
    order = np.argsort(own, kind="stable")
    return code[order], np.searchsorted(own[order], np.arange(count + 1))


def _spread(where: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of each of the words, and which of the words each belongs to."""
    n = where[words + 1] - where[words]
    return np.repeat(where[words] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(words)), n)


def _telling(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Sorted features that toxic documents of the sample have more often than chance."""
    found, seen, toxic = [], [], []
    for low in range(0, len(texts), CHUNK):
        words = split_words(texts.slice(low, CHUNK))
        code, where = _by_word(*features(words.distinct), len(words.distinct))
        mine = []
        for a, b in zip(words.begin[:-1], words.begin[1:]):
            at, _ = _spread(where, np.unique(words.codes[a:b]))
            mine.append(np.unique(code[at]))
        keys, number, n = np.unique(np.concatenate(mine), return_inverse=True, return_counts=True)
        found.append(keys)
        seen.append(n)
        toxic.append(np.bincount(number, np.repeat(labels[low:low + CHUNK], [len(m) for m in mine]), len(keys)))
    keys, number = np.unique(np.concatenate(found), return_inverse=True)
    n, k, share = np.bincount(number, np.concatenate(seen)), np.bincount(number, np.concatenate(toxic)), labels.mean()
    return keys[(n >= LEAST_DOCS) & (k - n * share > LEAST_Z * np.sqrt(n * share * (1 - share)))]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """The model of sampled texts and their labels."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(labels.mean()) if len(labels) else 0.0)
    keys = _telling(texts, labels)
    # (sentence, feature) pairs, features of weight only; and the sentences of each document
    owners, codes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    count = 0
    for low in range(0, len(texts), CHUNK):
        words = split_words(texts.slice(low, CHUNK))
        bags = sentences(words)
        own, code = features(words.distinct)
        at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
        good = keys[at] == code if len(keys) else np.zeros(len(code), bool)
        code, where = _by_word(own[good], at[good], len(words.distinct))
        at, of = _spread(where, bags.word)
        owners.append(bags.owner[of] + count)
        codes.append(code[at])
        sizes.append(np.diff(bags.first))
        count += len(bags.begin)
    owner, code, size = np.concatenate(owners), np.concatenate(codes), np.concatenate(sizes)
    labels, size = labels[size > 0], size[size > 0]
    first, group = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    weights = np.zeros(len(keys) + 1)
    weights[-1] = -4.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        logits = np.bincount(owner, weights[code], count) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
        left = np.exp(_or(logits, first))
        toxic = np.maximum(1 - left, 1e-9)
        # d loss / d logit: p for a clean document, -(left / toxic) * p for a toxic one
        pull = np.where(labels == 1, -left / toxic, 1.0)[group] * p
        grad = np.append(np.bincount(code, pull[owner], len(keys)), pull.sum())
        grad[:-1] += L2 * len(labels) / 100 * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        weights -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Model(keys, weights[:-1], float(weights[-1]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents. Their ids are chosen without reading texts; the driver gets
    the texts of at most ``sample`` documents of at most ``SAMPLE_CHARS`` characters."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("__y")).orderBy(F.xxhash64(F.lit("toxicity"), "__k"), "__k").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__key") == F.col("__k"))
    rows = rows.where(F.char_length("text") <= SAMPLE_CHARS)
    found = rows.groupBy("__k").agg(F.min("__y").alias("y"), F.min("text").alias("text")).orderBy("__k").toArrow()
    return fit(found["text"].combine_chunks(), found["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", offence: float = 0.5) -> DataFrame:
    """``keep`` of each row as ``row``, its score, the highest sentence score, and the offending sentences."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, worst double, offending array<string>"

    def judge(batches):
        for batch in parts(batches, size=2 * PART_BYTES):
            texts = batch.column("text")
            words = split_words(texts)
            bags = sentences(words)
            n, first = batch.num_rows, bags.first
            total, worst, found = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            if model.constant is not None:
                total[:] = worst[:] = model.constant
            else:
                total[:] = worst[:] = 1 / (1 + np.exp(-model.bias))  # of a text without words
                value = np.zeros(len(words.distinct))  # weights of the distinct words first, then of all sentences
                if len(model.keys):
                    own, code = features(words.distinct)
                    at = np.minimum(np.searchsorted(model.keys, code), len(model.keys) - 1)
                    value = np.bincount(own, np.where(model.keys[at] == code, model.weights[at], 0.0), len(words.distinct))
                if len(bags.begin):
                    logits = np.bincount(bags.owner, value[bags.word], len(bags.begin)) + model.bias
                    some = np.flatnonzero(first[1:] > first[:-1])
                    total[some] = -np.expm1(_or(logits, first[some]))
                    p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
                    worst[some] = np.maximum.reduceat(p, first[some])
                    last = np.append(bags.begin[1:], len(words.codes)) - 1
                    for s in np.flatnonzero(p >= offence).tolist():
                        found[int(np.searchsorted(first, s, side="right")) - 1].append(
                            words.data[words.start[bags.begin[s]]:words.end[last[s]]].tobytes().decode())
            yield pa.record_batch([batch.column("row"), pa.array(np.clip(total, 0, 1)), pa.array(worst), pa.array(found, pa.list_(pa.string()))],
                                  names=["row", "score", "worst", "offending"])

    return rows.mapInArrow(judge, schema)
