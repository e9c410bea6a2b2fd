"""Exact ids of whole texts by a public tokenizer, with each distinct piece encoded once.

A batch of texts is cut where the tokenizers used here always end a pre-token: before white
space, and between a letter and a following ASCII digit or mark (but the apostrophe, which
starts contractions). The distinct pieces are encoded by the tokenizers library, many joined
in one call, and the ids of a text are those of its pieces in a row. ``tests/llm`` holds the
result against encoding whole texts. A worker keeps the ids of short pieces from batch to batch, of a bounded number of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that are joined for one call.
JOINED = 2000
#: Pieces whose ids a worker keeps from batch to batch, and the bytes of the longest of them.
KEPT, KEPT_BYTES = 800_000, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each position is white space beyond ASCII."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return (((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
            | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
            | ((three == 0xE2) & (two == 0x80) & (((one >= 0x80) & (one <= 0x8A)) | np.isin(one, [0xA8, 0xA9, 0xAF])))
            | ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
            | ((three == 0xE3) & (two == 0x80) & (one == 0x80)))


class Encoder:
    """``spaced``: white space belongs to the following piece; else it is dropped and A-Z lower-cased."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.tokenizer.encode_special_tokens = True
        # what stands between joined pieces: it is a pre-token of its own, of one id
        self.between = "\n" if spaced else " \x01 "
        ids = self.tokenizer.encode("\x01" if not spaced else "\n", add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        # pieces of earlier batches, the ids of all of them in a row, where each one's ids begin, and how many they are
        self.kept = pa.array([], pa.large_string())
        self.kept_ids, self.kept_at = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)

    def pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts in a row, and where each text's pieces begin."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        cut = np.zeros(len(data) + 1, bool)
        space = _SPACE[data]
        if len(data) > 1:
            at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            cut[at[~_wide_space(data, at)]] = True
            cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[offsets] = True
        cut[-1] = True
        starts = np.flatnonzero(cut)
        begin = np.searchsorted(starts, offsets)
        if not self.spaced:
            moved = np.concatenate([[0], np.cumsum(~space)])
            starts, data = moved[starts], _LOWER[data[~space]]
        found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return found.dictionary_encode(), begin

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and where each piece's ids begin."""
        if self.spaced:
            plain = [not (x[:2].isspace() or x[:1] in "\t\n\v\f\r" or x[1:2].isspace()) and "\n" not in x and x.strip() != "" and not x[-1].isspace() for x in found]
        else:
            plain = ["\x01" not in x and x != "" for x in found]
        lengths, ids, order = np.zeros(len(found), np.int64), [], []
        simple = [i for i, p in enumerate(plain) if p and self.mark is not None]
        odd = [i for i, p in enumerate(plain) if not (p and self.mark is not None)]
        for k in range(0, len(simple), JOINED):
            group = simple[k:k + JOINED]
            got = np.array(self.tokenizer.encode_batch_fast(
                [self.between.join([found[i] for i in group])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(got == self.mark)
            if len(ends) != len(group) - 1:
                odd += group
                continue
            edges = np.concatenate([[-1], ends, [len(got)]])
            lengths[group] = np.diff(edges) - 1
            ids.append(got[got != self.mark])
            order += group
        for k in range(0, len(odd), JOINED):
            for i, e in zip(odd[k:k + JOINED], self.tokenizer.encode_batch_fast([found[i] for i in odd[k:k + JOINED]], add_special_tokens=False)):
                lengths[i] = len(e.ids)
                ids.append(np.array(e.ids, np.int64))
                order.append(i)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        # ``flat`` stands in the order of encoding; say where each piece begins in it
        begin = np.zeros(len(found), np.int64)
        if order:
            begin[order] = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        return flat.astype(np.uint32), np.stack([begin, lengths])

    def looked_up(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for distinct pieces: only those that earlier batches did not have are encoded."""
        at = pc.fill_null(pc.index_in(found, value_set=self.kept), -1).to_numpy(zero_copy_only=False)
        new, old = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        fresh, places = self.encode(found.take(pa.array(new)).to_pylist())
        flat, where = np.concatenate([self.kept_ids, fresh]), np.zeros((2, len(found)), np.int64)
        where[:, old] = self.kept_at[:, at[old]]
        where[:, new] = places
        where[0, new] += len(self.kept_ids)
        short = pc.less_equal(pc.binary_length(found), KEPT_BYTES).to_numpy(zero_copy_only=False)
        keep = new[short[new]]
        if len(self.kept) + len(keep) > KEPT:  # begin again with what this batch has
            keep = np.flatnonzero(short)[:KEPT]
            self.kept, self.kept_ids, self.kept_at = self.kept[:0], self.kept_ids[:0], self.kept_at[:, :0]
        first, length = where[:, keep]
        ends = np.concatenate([[0], np.cumsum(length)])
        self.kept = pa.concat_arrays([self.kept, found.take(pa.array(keep))])
        self.kept_at = np.concatenate([self.kept_at, np.stack([len(self.kept_ids) + ends[:-1], length])], 1)
        self.kept_ids = np.concatenate([self.kept_ids, flat[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]])
        return flat, where

    def ids(self, texts: pa.Array, end: int, at_once: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts: first, last + 1, their ids with ``end`` after each text, and where each text begins.

        A run has about ``at_once`` pieces, or one text.
        """
        coded, begin = self.pieces(texts)
        flat, (first, length) = self.looked_up(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(begin, begin[low] + at_once, side="right")) - 1)
            high = min(high, len(texts))
            own = codes[begin[low]:begin[high]]
            size = length[own]
            ends = np.concatenate([[0], np.cumsum(size)])
            out = flat[np.repeat(first[own] - ends[:-1], size) + np.arange(ends[-1])]
            bounds = ends[begin[low:high + 1] - begin[low]]
            out = np.insert(out, bounds[1:], np.uint32(end))
            yield low, high, out, bounds + np.arange(high - low + 1)
            low = high


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaced)
