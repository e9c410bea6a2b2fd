"""Words of whole batches of texts as arrays, with each distinct word held once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of text whose words are held as arrays at once; one longer text is a part of its own.
PART_BYTES = 6 << 20


def parts(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(low, high - low)
            low = high


class Words(NamedTuple):
    """Words of texts in a row: ``codes`` into ``distinct``; text i has words ``begin[i]`` to ``begin[i + 1]``.

    ``start`` and ``end`` are byte places in ``data``; ``newline`` says whether a line break stands before a word.
    """

    codes: np.ndarray
    distinct: pa.Array
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    newline: np.ndarray
    data: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
    else:
        offsets, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # where one text ends and the next begins
    edge[offsets] = True
    solid = np.concatenate([[False], ~space, [False]])
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    begin = np.searchsorted(start, offsets)
    # all bytes but spaces are in a word, so the words follow each other without them
    moved = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(_LOWER[data[~space]])))
    coded = found.dictionary_encode()
    lines = np.searchsorted(np.flatnonzero(data == 10), start)
    newline = np.concatenate([[True], lines[1:] != lines[:-1]]) if len(start) else np.zeros(0, bool)
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, begin, start, end, newline, data)


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(x) for x in strings.cast(pa.large_binary()).to_pylist()), np.uint64, len(strings))
