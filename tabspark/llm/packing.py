"""Documents packed into sequences of a fixed length by linear grouping.

Texts are encoded and cut into pieces. How many pieces of each length there are is a histogram
of at most ``capacity`` numbers, whatever the table's size, and the packing is planned on it:

* Large lengths are put in falling order into groups of equal cardinality, and rounded up to
  the largest of their group, so that few sizes remain.
* Configurations (how many pieces of each size fill a sequence) are optimised by a linear
  programme; new ones are found by a knapsack over its prices until none saves anything.
* Each configuration is used as often as the whole part of its number says. The longest actual
  pieces of its groups take the rounded places, the last place takes the longest piece that fits.
* Everything else, the small pieces above all, is best-fit into the fullest sequences, in falling order.

The plan is a list of runs: from piece number r0 of a length on, n pieces go to n sequences in a row.
Pieces are numbered within their length, and look their run up.

A null text is empty (its end id alone); repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabspark.llm.common import SLICES, frugal, running, stored
from tabspark.llm.tokens import encoder

CAPACITY = 1024
#: Lengths above this share of the capacity are large.
LARGE = 1 / 4
GROUPS = 32
END = 2


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(row, text) to (row, piece, start, length, ids_crc32); only the first piece of a text may be short when it is cut."""
    fields = docs.schema["row"].dataType
    schema = f"row {fields.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches):
        for batch in batches:
            texts, rows = batch.column("text"), batch.column("row")
            for low, high, ids, begin in encoder(tokenizer, True).ids(texts, end, 1 << 18):
                out: dict[str, list] = defaultdict(list)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for i in range(high - low):
                    size = int(begin[i + 1] - begin[i])
                    n = -(-size // capacity)
                    edges = [0, *(size - capacity * (n - k) for k in range(1, n + 1))]
                    for k in range(n):
                        out["of"].append(low + i)
                        out["piece"].append(k)
                        out["start"].append(edges[k])
                        out["length"].append(edges[k + 1] - edges[k])
                        at = int(begin[i]) + edges[k]
                        out["crc"].append(zlib.crc32(raw[4 * at:4 * (at + edges[k + 1] - edges[k])]))
                yield pa.record_batch([rows.take(pa.array(out["of"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                                       pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())],
                                      names=["row", "piece", "start", "length", "ids_crc32"])

    return docs.select("row", "text").mapInArrow(frugal(cut), schema)


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations of the sizes and how often to use each: the linear programme by column generation."""
    k = len(sizes)
    size = np.array(sizes)
    columns = [np.where(np.arange(k) == i, capacity // size[i], 0) for i in range(k)]
    basis = np.array(columns, float).T
    need = np.array(wanted, float)
    for _ in range(40 * k + 100):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the best configuration at these prices: an unbounded knapsack over whole capacities
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fits = size <= c
            gain = np.where(fits, value[np.where(fits, c - size, 0)] + price, 0)
            best = int(gain.argmax())
            if gain[best] > value[c - 1] + 1e-12:
                value[c], last[c] = gain[best], best
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                new[last[c]] += 1
                c -= size[last[c]]
        amounts, change = np.linalg.solve(basis, need), np.linalg.solve(basis, new)
        ratio = np.full(k, np.inf)
        ratio[change > 1e-9] = np.maximum(amounts[change > 1e-9], 0) / change[change > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
    amounts = np.linalg.solve(basis, need)
    return [(basis[:, i].round().astype(int), float(x)) for i, x in enumerate(amounts) if x > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece, one past the last, first sequence, offset) for pieces of each length."""
    left = {int(l): int(n) for l, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)  # pieces of a length that have a place
    runs: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # sequences, room, (length, first piece, offset)

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        return first

    if left.get(capacity):
        n = left[capacity]
        runs.append((n, 0, [(capacity, take(capacity, n), 0)]))
    falling = [l for l in sorted(left, reverse=True) if capacity * large < l < capacity and left[l]]
    count = sum(left[l] for l in falling)
    if count:
        # groups of equal cardinality: stretches of the falling order, each a list of [length, pieces]
        share, members, at = -(-count // groups), [[]], 0
        for length in falling:
            n = left[length]
            while n:
                if at == share:
                    members.append([])
                    at = 0
                m = min(n, share - at)
                members[-1].append([length, m])
                n, at = n - m, at + m
        # groups whose largest length is the same have one size
        merged: list[list[list[int]]] = []
        for m in members:
            if merged and merged[-1][0][0] == m[0][0]:
                merged[-1] += m
            else:
                merged.append(m)
        tops = [m[0][0] for m in merged]
        found = configurations(tops, [sum(n for _, n in m) for m in merged], capacity)
        rising = sorted(l for l in left if left[l] and l < capacity)

        def longest(below: int) -> int | None:
            """The longest length up to a limit of which pieces are left."""
            while (k := bisect_right(rising, below)) and not left[rising[k - 1]]:
                rising.pop(k - 1)
            return rising[k - 1] if k else None

        for pattern, amount in sorted(found, key=lambda x: -x[1]):
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            times = int(amount + 1e-6)
            while times:
                # the planned places take the longest pieces of their groups; what rounding saved goes to the last place
                chosen: list[int] = []
                for g in slots[:-1]:
                    length = longest(tops[g])
                    if length is None or g + 1 < len(tops) and length <= tops[g + 1]:
                        break
                    chosen.append(length)
                last = longest(capacity - sum(chosen)) if len(chosen) == len(slots) - 1 else None
                if last is None:
                    break
                chosen.append(last)
                n = min([times] + [left[l] // chosen.count(l) for l in set(chosen)])
                if not n:
                    break
                items, offset = [], 0
                for length in chosen:
                    items.append((length, take(length, n), offset))
                    offset += length
                runs.append((n, capacity - offset, items))
                times -= n
    # the rest by best fit, over sequences of equal room at once
    rooms: dict[int, list[tuple[int, list]]] = defaultdict(list)
    for n, room, items in runs:
        rooms[room].append((n, items))
    kinds = sorted(r for r in rooms if r)
    for length in sorted(left, reverse=True):
        while left[length]:
            k = bisect_left(kinds, length)
            if k == len(kinds):
                fit = capacity // length
                n, several = divmod(left[length], fit)
                for m, each in ((n, fit), (1, several)):
                    if m and each:
                        items = [(length, take(length, m), j * length) for j in range(each)]
                        room = capacity - each * length
                        if room and not rooms[room]:
                            insort(kinds, room)
                        rooms[room].append((m, items))
                continue
            room = kinds[k]
            n, items = rooms[room].pop()
            m = min(n, left[length])
            if n > m:  # the others of this run keep their room; pieces of theirs come after those taken now
                rooms[room].append((n - m, [(l, first + m, o) for l, first, o in items]))
            if not rooms[room]:
                kinds.pop(k)
            new = room - length
            if new and not rooms[new]:
                insort(kinds, new)
            rooms[new].append((m, [*items, (length, take(length, m), capacity - room)]))
    out, base = [], 0
    for room in sorted(rooms):
        for n, items in rooms[room]:
            out += [(l, first, first + n, base, o) for l, first, o in items]
            base += n
    return out


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``keep`` of each row's pieces with piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces_of(docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text")), tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = spark.createDataFrame([(l, a, b, s, o) for l, a, b, s, o in plan(histogram, capacity)],
                                   "of bigint, low bigint, high bigint, first bigint, offset bigint")
    turn = F.xxhash64("row", "piece", "ids_crc32")
    numbered = running(cut.withColumn("turn", turn), ["length"], [F.pmod("turn", F.lit(SLICES)), F.col("turn")], {"number": F.lit(1).cast("bigint")})
    found = numbered.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return found.select("row", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")
