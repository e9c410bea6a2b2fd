"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 automaton.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are: the merges applied to
the bytes of both give the two back. So the encoding is what a nondeterministic transducer reads: it follows the
trie of tokens, may end a token wherever the trie does, and may do so only if the token fits the one before.
Each prefix of the input has one encoding, so one path has just ended a token and the others are inside one.

``Transducer`` determinises this byte by byte. Any prefix has an encoding, so which paths are open follows from the
bytes alone: a state is the set of their places in the trie, and an arc names the tokens that may end after its byte. The one of
them that fits the token before it ends the encoding of the prefix; this last token is all that is kept of a prefix, for what a
path holds back is traced from it. A token is emitted as soon as all open paths agree on it, that is
after a lookahead of at most the longest token; a short match is read to its end first. States, arcs and fitting pairs are built when first met,
and thrown away when there are too many, so memory is bounded whatever the texts.

``Decoder`` takes ids in pieces of any length and gives whole characters only: an automaton over the bytes of UTF-8,
whose steps are composed to one per token when first met, tells how many bytes at the end belong to an open character.

A null or empty text has no ids. Repeated rows are encoded alike, an empty table gives no rows, and a row's own
columns are kept in ``row``, whatever their names. Bytes that are not UTF-8 never reach the encoder: Spark's strings
arrive here decoded. Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabspark.llm.common import frugal
from tabspark.llm.texts import parts

#: Arcs and fitting pairs kept; beyond, they are built anew.
ARCS, PAIRS = 100_000, 200_000
#: Encoded pieces of a generation; the one before it is kept too, and what is met again moves on to the new one.
PIECES = 200_000
#: Pieces longer than this are not remembered.
PIECE_BYTES = 64
#: First bytes of a match after which the state is remembered.
HEAD_BYTES = 5
#: Bytes of a match that are read before the ids that are sure are given out.
READ_BYTES = 1 << 16
#: The rank of what is no token.
_NEVER = 1 << 60

#: Places in the trie that are open, and the last token of each prefix that they may go back to.
State = tuple[tuple[int, ...], tuple[int, ...]]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, a line ``base64 rank`` for each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """Ids of single matches of the pattern; ``feed`` and ``rest`` for input that comes in pieces."""

    def __init__(self, ranks: dict[bytes, int], arcs: int = ARCS, pairs: int = PAIRS):
        self.ranks, self.most_arcs, self.most_pairs = ranks, arcs, pairs
        self.token = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.size = {i: len(t) for t, i in ranks.items()}
        # the trie of tokens: by node and byte the next node; whether a node goes on, its depth, and the token that ends there
        self.trie: dict[int, int] = {}
        self.ends, self.inner, self.depth = [-1], [False], [0]
        for data, rank in ranks.items():
            node = 0
            for deep, byte in enumerate(data, 1):
                self.inner[node] = True
                node = self.trie.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.depth.append(deep)
            self.ends[node] = rank
        # a token that its own merges do not give is only ever a whole match
        self._histories: dict[int, tuple[tuple[int, bytes, bytes], ...] | None] = {}
        self._fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Start with no states but the first: one path at the root."""
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _numbered(self, places: tuple[int, ...]) -> int:
        number = self.number.setdefault(places, len(self.states))
        if number == len(self.states):
            self.states.append(places)
        return number

    def _traced(self, last: Sequence[int], at: int) -> list[int]:
        """The encoding of the first ``at`` bytes, from the last token of each prefix."""
        out, size = [], self.size
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def rest(self, state: State | None) -> list[int]:
        """What is held back by the path that has just ended a token: the ids to come if the input ends here."""
        return self._traced(state[1], len(state[1]) - 1) if state else []

    def history(self, token: int) -> tuple[tuple[int, bytes, bytes], ...] | None:
        """What a token's own merges leave first and last after each merge, with its rank; None if they do not give the token."""
        if token not in self._histories:
            symbols, steps = [bytes([b]) for b in self.token[token]], []
            steps.append((-1, symbols[0], symbols[-1]))
            while len(symbols) > 1:
                ranks = [self.ranks.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
                best = min(ranks)
                if best == _NEVER:
                    break
                at = ranks.index(best)
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, symbols[0], symbols[-1]))
            self._histories[token] = tuple(steps) if len(symbols) == 1 else None
        return self._histories[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether a token may follow another (or, after -1, begin a match).

        Until a merge crosses the border, both tokens merge as they do alone, the lowest rank first and of equal ranks the
        leftmost; they fit if no crossing merge ever comes first.
        """
        after = self.history(right)
        if left < 0 or after is None:
            return after is not None
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= self.most_pairs:
                self._fits.clear()
            known = self._fits[key] = not self._crosses(self.history(left), after)
        return known

    def _crosses(self, before: tuple, after: tuple) -> bool:
        i = j = 0
        while True:
            cross = self.ranks.get(before[i][2] + after[j][1], _NEVER)
            first = before[i + 1][0] if i + 1 < len(before) else _NEVER
            second = after[j + 1][0] if j + 1 < len(after) else _NEVER
            if cross != _NEVER and cross < first and cross <= second:
                return True
            if first == second == _NEVER:
                return False
            if first <= second:
                i += 1
            else:
                j += 1

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The state after a byte, and the tokens that may end there with their sizes, the longest first."""
        after, found = [], []
        for node in self.states[state]:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                after.append(node)
            token = self.ends[node]
            if token >= 0 and self.history(token) is not None:
                found.append((token, self.size[token]))
        # the paths in order of their places in the trie, the deepest first; the one at the root is the last
        self.arcs[state << 8 | byte] = step = (self._numbered((*after, 0)), tuple(found))
        return step

    def _read(self, state: int, data: bytes, last: list[int]) -> int:
        """Read bytes from a state on, append the last token of each prefix, and return the state reached."""
        arcs, known = self.arcs, self._fits
        for byte in data:
            step = arcs.get(state << 8 | byte)
            if step is None:
                if len(arcs) >= self.most_arcs:  # keep the state we are in, forget the others
                    places = self.states[state]
                    self.forget()
                    arcs, state = self.arcs, self._numbered(places)
                step = self._arc(state, byte)
            state, found = step
            for token, size in found:
                before = last[-size]
                fits = before < 0 or known.get(before << 32 | token)
                if fits or fits is None and self.fits(before, token):
                    last.append(token)  # no other path ends here, for a prefix has one encoding
                    break
        return state

    def _begun(self, head: bytes) -> tuple[int, list[int]]:
        """The state after the first bytes of a match, and the last token of each prefix."""
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= self.most_arcs:
                self.heads.clear()
            last = [-1]
            state = self._read(0, head, last)
            known = self.heads[head] = state, tuple(last)
        return known[0], list(known[1])

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= READ_BYTES:
            state, last = self._begun(piece[:HEAD_BYTES])
            self._read(state, piece[HEAD_BYTES:], last)
            return self._traced(last, len(piece))
        state, out = None, []
        for low in range(0, len(piece), READ_BYTES):
            state = self.feed(state, piece[low:low + READ_BYTES], out)
        return out + self.rest(state)

    def feed(self, state: State | None, data: bytes, out: list[int]) -> State:
        """Read bytes from a state on (none, or 0: the beginning), append the ids that are sure, and return the state reached."""
        places, last = state or ((0,), (-1,))
        last = list(last)
        places = self.states[self._read(self._numbered(places), data, last)]
        # the encodings of what is before the open paths agree up to where they, traced back, meet
        heads = {len(last) - 1 - self.depth[node] for node in places}
        while len(heads) > 1:
            at = max(heads)
            heads.remove(at)
            heads.add(at - self.size[last[at]])
        sure = heads.pop()
        out += self._traced(last, sure)
        return places, tuple(last[sure:])


class Encoder:
    """Ids of whole texts: each match of the pattern is read by the transducer on its own."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.find, self.transducer = regex.compile(pattern).findall, Transducer(read_ranks(path))
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    data = piece.encode("utf-8")
                    ids = tuple(self.transducer.encode(data))
                    if len(data) > PIECE_BYTES:
                        out += ids
                        continue
                if len(known) >= PIECES:
                    self.older, self.known = known, {}
                    known = self.known
                known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker: what one task has built, the next one uses."""
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder({i: t for t, i in read_ranks(path).items()})


#: States of the UTF-8 automaton: the bytes that may follow, and the state after each.
#: 0: between characters. 1, 2, 3: so many continuation bytes are open. 4 to 7: the first continuation byte is restricted.
_CONTINUED = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2),
              4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
_FIRST = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
          (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))


def utf8_step(state: int, byte: int) -> tuple[int, bool]:
    """The state after a byte, and whether the byte was allowed there; a wrong byte is looked at again as a first one."""
    if state:
        low, high, after = _CONTINUED[state]
        if low <= byte <= high:
            return after, True
    for low, high, after in _FIRST:
        if low <= byte <= high:
            return after, state == 0
    return 0, False


class Decoder:
    """Bytes of ids that come in pieces; what is given out ends at the end of a character.

    ``broken`` counts the places where the bytes so far are not UTF-8; such bytes are given out as they are.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        # tokens that are whole characters leave the automaton where it is
        self.whole = np.array([self._whole(tokens[i]) if i in tokens else False for i in range(max(tokens, default=-1) + 1)], bool)
        # by state and token: the state after it, the bytes at its end that belong to an open character, wrong places
        self.steps: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.restart()

    @staticmethod
    def _whole(data: bytes) -> bool:
        try:
            return data.decode() is not None
        except UnicodeDecodeError:
            return False

    def restart(self) -> None:
        self.state, self.open, self.broken = 0, b"", 0

    def _step(self, state: int, token: int) -> tuple[int, int, int]:
        data, broken, start, opened = self.tokens[token], 0, state, state == 0
        tail = 0
        for i, byte in enumerate(data):
            state, right = utf8_step(state, byte)
            broken += not right
            # a character begins with this byte if nothing was open, or if what was open broke off here
            if (opened or not right) and state:
                tail = len(data) - i
            opened = state == 0
        held = tail if state else 0
        if state and not tail:
            held = -1  # the character that was open before is still open
        self.steps[start, token] = found = (state, held, broken)
        return found

    def feed(self, ids: Sequence[int]) -> bytes:
        """The bytes of the whole characters so far that were not given out before."""
        ids = np.asarray(ids, np.int64)
        pieces = list(map(self.tokens.__getitem__, ids.tolist()))
        state, kept, at = self.state, len(self.open), 0
        # between characters, whole tokens change nothing: go from one broken token to the next
        for start in [0, *np.flatnonzero(~self.whole[ids]).tolist()]:
            at = max(at, start)
            while at < len(pieces) and (state or at == start):
                token = int(ids[at])
                state, held, broken = self.steps.get((state, token)) or self._step(state, token)
                kept = 0 if not state else kept + len(pieces[at]) if held < 0 else held
                self.broken += broken
                at += 1
        data = self.open + b"".join(pieces)
        self.state = state
        cut = len(data) - kept
        self.open = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        """The bytes of a character that never ended; the next text may follow."""
        rest = self.open
        self.state, self.open = 0, b""
        self.broken += bool(rest)
        return rest


Batches = Iterator[pa.RecordBatch]


def _encoded(path: str, pattern: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = encoder(path, pattern)
        for batch in parts(batches):
            # only plain tuples and dicts of numbers are made here, and no cycles
            gc.disable()
            try:
                found = [np.asarray(own.encode(t), np.int32) if t else np.zeros(0, np.int32) for t in batch.column("text").to_pylist()]
            finally:
                gc.enable()
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.record_batch([batch.column("row"), ids], names=["row", "ids"])
    return run


def _decoded(path: str, ids: str, chunk: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = decoder(path)
        for batch in batches:
            lists, data, broken = batch.column(batch.schema.names.index(ids)), [], []
            ends = np.asarray(lists.offsets)
            flat = lists.values.to_numpy(zero_copy_only=False)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own.restart()
                whole = [own.feed(flat[i:min(i + chunk, b)]) for i in range(a, b, chunk)]
                data.append(b"".join([*whole, own.finish()]))
                broken.append(own.broken)
            yield pa.record_batch([*batch.columns, pa.array(data, pa.binary()), pa.array(broken, pa.int32())],
                                  names=[*batch.schema.names, "decoded", "broken"])
    return run


def _with_row(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return rows, rows.select("row").schema.simpleString()[len("struct<row:"):-1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(row, ids): each row with the ids of its whole text."""
    rows, kept = _with_row(docs, text)
    return rows.mapInArrow(_encoded(path, pattern), f"row {kept}, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", chunk: int = 4096) -> DataFrame:
    """The rows with ``decoded`` (binary) and ``broken`` (places that are not UTF-8); ids are read ``chunk`` at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decoded(path, ids, chunk), f"{schema}, decoded binary, broken int")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = 4096) -> DataFrame:
    """(row, ids, decoded, broken): both in one pass, as ``decode`` of ``encode`` gives them."""
    rows, kept = _with_row(docs, text)
    coded, told = _encoded(path, pattern), _decoded(path, "ids", chunk)
    return rows.mapInArrow(frugal(lambda batches: told(coded(batches))), f"row {kept}, ids array<int>, decoded binary, broken int")


def digests(rows: DataFrame) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256, broken) of encoded and decoded rows."""
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return rows.select("row", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "broken")
