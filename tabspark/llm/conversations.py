"""Repairs of damaged conversations of least cost: a Viterbi search made parallel by rank convergence.

The roles of a whole conversation begin with s, u, a and read ``(s?(ua)+)?``. A row may be kept (K, cost 0), given
the role user or assistant (R, 2) or deleted (D, 3; blank and duplicate rows must be), and an empty user or assistant row may
be inserted anywhere (I, 2). A truncated row that stays costs 1 more. Of the cheapest repairs the one whose edits,
written as letters in order, come first in ASCII order is taken.

The search runs backwards over the rows with a vector of four costs: what the rest costs, if so far nothing,
an s, a u or an a was written last. Rows of a conversation are cut into chunks of bounded length, wherever partitions end too.

1. Every chunk starts from a speculative vector (as if the conversation ended there) and keeps the vector it reaches.
2. Fix-up passes: a chunk whose true start is not parallel to the vector it was run from is run again, beside its old run,
   and only until the two differ by a constant, for from there on the old run holds. A pass carries
   vectors through spans of chunks, 64 times longer with each pass, and passes end when no border moves.
3. The vectors, now true, drive one walk forward: at each row the first letter in ASCII order that keeps the cost least.

A step depends only on the kind of row and on the differences in the vector, and few vectors occur; each step is
computed once a worker and then looked up. A row costs one byte in the passes; texts are met only by the last walk.

Rows that are alike are counted before the sort, so no conversation, turn or repeated text is too large for one
partition. The walk, and the hash of the repaired rows, take a conversation's rows in a stream.

Null conv_ids are one conversation; null turns come first and count in no gap; null roles and texts are read as one space. Rows of
one turn are ordered by role, then by the hash of their text. An empty table gives no rows. Other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from tabspark.llm.common import SLIM_ROWS, WORD, joined, spread, stored

#: Rows of a chunk; a run of like rows stays in one chunk.
CHUNK = 4096
#: By this factor the spans of chunks grow from pass to pass.
SPAN = 64

#: What was written last: nothing, s, u, a. The state after an inserted or renamed row, and after a kept s, u, a.
_NEXT = (2, 2, 3, 2)
_KEPT = {0: (1, None, None, None), 1: (2, 2, None, 2), 2: (None, None, 3, None), 3: (None,) * 4}
_END = (0, 4, 2, 0)
#: A row's kind: 0 s, 1 u, 2 a, 3 another initial; 4 more if truncated; FORCED if it must go.
FORCED = 8
_ROLE = {2: "user", 3: "assistant"}


class Costs:
    """The vectors that occur, less their least entry, and the steps between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.of(_END)

    def of(self, vector) -> int:
        vector = tuple(vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def step(self, after: int, kind: int) -> tuple[int, int]:
        """The vector before a row, and by how much its least entry grew."""
        found = self.steps.get(after << 4 | kind)
        if found is None:
            rest = self.vectors[after]
            cost = [3 + r for r in rest]
            if kind != FORCED:
                more, kept = kind >> 2, _KEPT[kind & 3]
                cost = [min(cost[s], 2 + more + rest[_NEXT[s]], *([more + rest[kept[s]]] if kept[s] else [])) for s in range(4)]
            for _ in range(2):
                cost = [min(cost[s], 2 + cost[_NEXT[s]]) for s in range(4)]
            least = min(cost)
            found = self.steps[after << 4 | kind] = (self.of(c - least for c in cost), least)
        return found

    def back(self, kinds: bytes, after: int) -> tuple[int, int]:
        """The vector before a chunk, and the growth over it."""
        grown = 0
        for kind in reversed(kinds):
            after, more = self.step(after, kind)
            grown += more
        return after, grown

    def rerun(self, kinds: bytes, old: int, new: int) -> int | None:
        """By how much the growth of a run from ``new`` differs, if it meets the run from ``old`` inside the chunk."""
        more = 0
        for kind in reversed(kinds):
            if old == new:
                return more
            old, a = self.step(old, kind)
            new, b = self.step(new, kind)
            more += b - a
        return more if old == new else None

    def move(self, after: int, kind: int, state: int) -> tuple[str, int]:
        """The letters up to and with a row's own, and the state after them."""
        found = self.moves.get((after, kind, state))
        if found is None:
            before, grown = self.step(after, kind)
            now, rest, letters, at = self.vectors[before], self.vectors[after], "", state
            while not letters or letters[-1] == "I":
                left, kept = now[at] + grown, None if kind == FORCED else _KEPT[kind & 3][at]
                if left == 3 + rest[at]:
                    letters += "D"
                elif now[at] == 2 + now[_NEXT[at]]:
                    letters, at = letters + "I", _NEXT[at]
                elif kept is not None and left == (kind >> 2) + rest[kept]:
                    letters, at = letters + "K", kept
                else:
                    letters, at = letters + "R", _NEXT[at]
            found = self.moves[after, kind, state] = (letters, at)
        return found

    def walk(self, kinds: bytes, after: int, state: int) -> tuple[list[str], int]:
        """The letters for each row of a chunk from a state on, and the state reached."""
        afters = []
        for kind in reversed(kinds):
            afters.append(after)
            after = self.step(after, kind)[0]
        out = []
        for kind, after in zip(kinds, reversed(afters)):
            letters, state = self.move(after, kind, state)
            out.append(letters)
        return out, state


@lru_cache(maxsize=1)
def _costs() -> Costs:
    return Costs()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) after damage by a hash of conversation and turn; ``times`` 0: dropped, 2: repeated."""
    kind = F.crc32(F.concat(_text(F.col(conv)), F.lit(":"), _text(F.col(turn))).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text(F.col(text)), "[.!?]", "")).otherwise(_text(F.col(text)))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                       F.when(kind == 4, "user").otherwise(_text(F.col(role))).alias("role"), said.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("times"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text, times, fault, kind): like rows as one; fault 1 blank, 2 duplicate, 3 truncated.

    Fault and kind are those of the first of ``times`` rows; the others are blank or duplicates.
    """
    rows = rows.where("times > 0").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # the first turn of what a conversation says at more than one turn
    blank = ~F.col("text").rlike(WORD)
    by_turn = rows.where(~blank).groupBy("conv_id", "role", "digest", "turn").agg(F.lit(1).alias("one"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first"))
    again = by_turn.groupBy("conv_id", "role", "digest").agg(F.count("one").alias("turns"), F.min(turn).alias("at")).where("turns > 1")
    again = stored(again.select("conv_id", "role", "digest", "at"), "said-again")
    alike = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.any_value("text").alias("text"), F.sum("times").alias("times"))
    found = joined(alike, again, ["conv_id", "role", "digest"], "left", SLIM_ROWS)
    second = F.col("at").isNotNull() & ~F.col("turn").eqNullSafe(F.col("at.first"))
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    start = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(blank, 1).when(second, 2).when(~whole, 3).otherwise(0)
    return found.withColumn("fault", fault.cast("int")).withColumn(
        "kind", F.when(F.col("fault").isin(1, 2), FORCED).otherwise(start + F.when(F.col("fault") == 3, 4).otherwise(0)).cast("int")).select(
        "conv_id", "turn", "role", "digest", "text", "times", "fault", "kind")


#: What is known of a chunk: counts of faults and bad neighbours, known turns, distinct ones, first and last turn and initial.
_FACTS = {"blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "low": "bigint", "high": "bigint",
          "turns": "bigint", "first_turn": "bigint", "last_turn": "bigint", "first_initial": "string", "last_initial": "string"}
_COLUMNS = ["conv_id", "part", "chunk", "place", "role", "text", "times", "kinds", "after", "before", "grown", "facts"]
_GOOD = {("s", "u"), ("u", "a"), ("a", "u")}


class _Chunk:
    def __init__(self, conv):
        self.conv, self.kinds = conv, bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.high, self.first, self.last = 0, 0, None, None, None, None
        self.initials: list[str] = []

    def add(self, turn, initial: str, times: int, fault: int, kind: int) -> None:
        self.kinds.append(kind)
        self.kinds += bytes([FORCED]) * (times - 1)
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += times - 1
        self.illegal += times - 1  # nobody may speak twice
        if self.initials:
            self.illegal += (self.initials[1], initial) not in _GOOD
            self.initials[1] = initial
        else:
            self.initials = [initial, initial]
        if turn is not None:  # null turns come first, so known ones follow each other
            self.turns += turn != self.last
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.first, self.last = self.low, turn


def chunks(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """The rows in order, with their part, chunk and place, and before each chunk (place -1) what its speculative run gave.

    Written once: the rows of a chunk, and the chunks of a part, keep their numbers.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    schema = (f"conv_id {found.schema['conv_id'].dataType.simpleString()}, part int, chunk bigint, place bigint, role string, text string, "
              f"times bigint, kinds binary, after array<int>, before array<int>, grown bigint, "
              f"facts struct<{', '.join(f'{n}:{t}' for n, t in _FACTS.items())}>")
    facts = pa.struct([pa.field(n, pa.int64() if t == "bigint" else pa.string()) for n, t in _FACTS.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, chunk, number, place, kind_of = _costs(), None, -1, 0, None

        def closed(chunk: _Chunk, part: int) -> pa.RecordBatch:
            kinds = bytes(chunk.kinds)
            before, grown = costs.back(kinds, costs.end)
            fact = dict(zip(_FACTS, [
                *chunk.faults[1:], chunk.illegal, chunk.low, chunk.high, chunk.turns, chunk.first, chunk.last, *chunk.initials]))
            return pa.record_batch([
                pa.array([chunk.conv], kind_of), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([-1], pa.int64()),
                pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([kinds], pa.binary()),
                pa.array([list(_END)], pa.list_(pa.int32())), pa.array([list(costs.vectors[before])], pa.list_(pa.int32())),
                pa.array([grown], pa.int64()), pa.array([fact], facts)], names=_COLUMNS)

        part = 0
        for batch in batches:
            kind_of = batch.column("conv_id").type
            closed_now, numbers, places = [], [], []
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for conv, turn, initial, times, fault, kind in zip(*[batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "initial", "times", "fault", "kind")]):
                if chunk is None or conv != chunk.conv or len(chunk.kinds) >= size:
                    if chunk is not None:
                        closed_now.append(closed(chunk, part))
                    chunk, number = _Chunk(conv), number + 1
                chunk.add(turn, initial, times, fault, kind)
                numbers.append(number)
                places.append(place)
                place += 1
            n = batch.num_rows
            yield pa.record_batch([
                batch.column("conv_id"), batch.column("part"), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), batch.column("role"),
                batch.column("text"), batch.column("times"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32())),
                pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64()), pa.nulls(n, facts)], names=_COLUMNS)
            if closed_now:
                yield pa.Table.from_batches(closed_now).combine_chunks().to_batches()[0]
        if chunk is not None:
            yield closed(chunk, part)

    parts = found.repartitionByRange(spread(found.sparkSession), *order).sortWithinPartitions(*order)
    parts = parts.withColumns({"part": F.spark_partition_id(), "initial": F.substring("role", 1, 1)})
    return stored(parts.select("conv_id", "part", "turn", "initial", "times", "fault", "kind", "role", "text").mapInArrow(cut, schema), "chunked")


def fixed(heads: DataFrame, span: int = SPAN) -> DataFrame:
    """The chunk rows (conv_id, number, kinds, after, before, grown, ...) with true vectors."""
    spark, width = heads.sparkSession, span
    cols = heads.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads.schema.fields) + ", moved boolean"
    heads = heads.withColumn("moved", F.lit(False))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, group, vector = _costs(), None, None
        for batch in batches:
            out = {"after": [], "before": [], "grown": [], "moved": []}
            own = []
            for at, (conv, piece, edge, kinds, after, before, grown) in enumerate(zip(*[batch.column(c).to_pylist() for c in (
                    "conv_id", "span", "edge", "kinds", "after", "before", "grown")])):
                if group != (conv, piece):
                    group, vector = (conv, piece), costs.end
                if edge:
                    vector = costs.of(before)
                    continue
                old, reached, moved = costs.of(after), costs.of(before), False
                if vector != old:
                    more = costs.rerun(kinds, old, vector)
                    if more is None:
                        reached, grown = costs.back(kinds, vector)
                        moved = True
                    else:
                        grown += more
                out["after"].append(list(costs.vectors[vector]))
                out["before"].append(list(costs.vectors[reached]))
                out["grown"].append(grown)
                out["moved"].append(moved)
                own.append(at)
                vector = reached
            batch = batch.take(pa.array(own, pa.int64()))
            kind_of = {"after": pa.list_(pa.int32()), "before": pa.list_(pa.int32()), "grown": pa.int64(), "moved": pa.bool_()}
            yield pa.record_batch([pa.array(out[c], kind_of[c]) if c in out else batch.column(c) for c in [*cols, "moved"]], names=[*cols, "moved"])

    while True:
        rows = heads.withColumns({"span": F.floor(F.col("number") / width), "edge": F.lit(False)})
        # the vector of the chunk after a span
        edges = rows.where((F.col("number") % width == 0) & (F.col("number") > 0)).withColumns(
            {"span": F.col("span") - 1, "edge": F.lit(True), "kinds": F.lit(None).cast("binary")})
        rows = rows.unionByName(edges).repartition(spread(spark), "conv_id", "span").sortWithinPartitions("conv_id", "span", F.col("number").desc())
        heads = stored(rows.mapInArrow(again, schema), "fixed")
        if not heads.where(F.col("moved") & (F.col("number") % width == 0) & (F.col("number") > 0)).take(1):
            return heads.select(*cols)
        width *= span


class _Walk:
    """One conversation, its chunks and rows coming in order."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.hash, self.written = conv, 0, [], hashlib.sha256(), False
        self.cost, self.counts, self.turns, self.low, self.high = 0, [0, 0, 0, 0], 0, None, None
        self.last_turn = self.last_initial = None
        self.letters: Iterator[str] = iter(())
        self.seen = False

    def head(self, kinds: bytes, after, before, grown: int, fact: dict) -> None:
        costs = _costs()
        self.cost += grown + (0 if self.seen else before[0])
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += fact[name]
        if self.seen:
            self.counts[3] += (self.last_initial, fact["first_initial"]) not in _GOOD
        self.turns += fact["turns"] - (fact["first_turn"] is not None and fact["first_turn"] == self.last_turn)
        if fact["low"] is not None:
            self.low, self.high, self.last_turn = (fact["low"] if self.low is None else self.low), fact["high"], fact["last_turn"]
        self.last_initial, self.seen = fact["last_initial"], True
        # the state in which each row finds the conversation is known once its letters are
        letters, after_state = costs.walk(kinds, costs.of(after), self.state)
        self.letters, self.at, self.state = iter(letters), self.state, after_state
        self.audit.append("".join(letters))

    def say(self, role: str, text: str) -> None:
        if self.written:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.written = True

    def row(self, role: str, text: str, times: int) -> Iterator[tuple[str, str | None, str | None]]:
        """(letter, role, text) of each edit up to and with those of ``times`` like rows."""
        for _ in range(times):
            for letter in next(self.letters):
                if letter == "D":
                    yield letter, role, text
                    continue
                if letter == "K":
                    self.at = _KEPT[{"s": 0, "u": 1, "a": 2}[role[:1]]][self.at]
                    who, said = role, text
                else:
                    self.at = _NEXT[self.at]
                    who, said = _ROLE[self.at], "" if letter == "I" else text
                self.say(who, said)
                yield letter, who, said

    def close(self) -> Iterator[tuple[str, str | None, str | None]]:
        while _END[self.state]:
            self.state = _NEXT[self.state]
            self.audit.append("I")
            self.say(_ROLE[self.state], "")
            yield "I", _ROLE[self.state], ""


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[_Walk, tuple | None]]]:
    """For each batch the edits made in it; an edit of None closes its conversation."""
    walk = None
    for batch in batches:
        out = []
        for conv, place, role, text, times, kinds, after, before, grown, fact in zip(*[batch.column(c).to_pylist() for c in (
                "conv_id", "place", "role", "text", "times", "kinds", "after", "before", "grown", "facts")]):
            if walk is None or walk.conv != conv:
                if walk is not None:
                    out += [(walk, edit) for edit in walk.close()]
                    out.append((walk, None))
                walk = _Walk(conv)
            if kinds is not None:
                walk.head(kinds, after, before, grown, fact)
            elif role is not None:
                out += [(walk, edit) for edit in walk.row(role, text, times)]
        yield out
    if walk is not None:
        yield [*((walk, edit) for edit in walk.close()), (walk, None)]


def planned(rows: DataFrame, size: int = CHUNK, span: int = SPAN) -> DataFrame:
    """The stream of the walk: for each conversation a mark, then chunks with true vectors and their rows, in order.

    ``rows`` are (conv_id, turn, role, text, times).
    """
    if not isinstance(rows.schema["conv_id"].dataType, StringType):
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    table = chunks(faults(rows), size)
    said = table.where("kinds is null")
    heads = table.where("kinds is not null").select("conv_id", "part", "chunk", "kinds", "after", "before", "grown", "facts")
    # chunks are numbered within their conversations; only those of more than one chunk go through the passes
    count = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")
    count = stored(count, "long-conversations")
    if count.take(1):
        heads = joined(heads, count, ["conv_id"])
        lone = heads.where("chunks is null").drop("chunks")
        numbered = heads.where("chunks is not null").drop("chunks").withColumn(
            "number", F.row_number().over(W.partitionBy("conv_id").orderBy("part", "chunk")).cast("bigint") - 1)
        heads = lone.unionByName(fixed(stored(numbered, "numbered"), span).drop("number"))
    mark = rows.select("conv_id").distinct().withColumn("part", F.lit(-1))
    stream = said.unionByName(heads.withColumn("place", F.lit(-1).cast("bigint")), allowMissingColumns=True).unionByName(mark, allowMissingColumns=True)
    return stream.repartition(spread(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "chunk", "place")


def repaired(rows: DataFrame, size: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(conv_id, step, edit, role, text): every edit in order; role and text as repaired, of a deleted row as they were."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = 0, None
        for edits in _walked(batches):
            out = []
            for walk, edit in edits:
                step, last = (step if walk is last else 0), walk
                if edit is not None:
                    out.append((walk.conv, step, *edit))
                    step += 1
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                      names=["conv_id", "step", "edit", "role", "text"])

    stream = planned(rows, size, span)
    kind = pa.string() if isinstance(stream.schema["conv_id"].dataType, StringType) else pa.int64()
    return stream.mapInArrow(run, f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, step bigint, edit string, role string, text string")


def report(rows: DataFrame, size: int = CHUNK, span: int = SPAN) -> DataFrame:
    """A row for each conversation: its faults, the cost and the letters of its repair, and the hash of the repaired rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edits in _walked(batches):
            done = [w for w, edit in edits if edit is None]
            if done:
                gaps = [0 if w.low is None else w.high - w.low + 1 - w.turns for w in done]
                yield pa.record_batch([
                    pa.array([w.conv for w in done], kind), pa.array(gaps, pa.int64()),
                    *[pa.array([w.counts[i] for w in done], pa.int64()) for i in range(4)], pa.array([w.cost for w in done], pa.int64()),
                    pa.array(["".join(w.audit) for w in done], pa.string()), pa.array([w.hash.hexdigest() for w in done], pa.string())],
                    names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    stream = planned(rows, size, span)
    kind = pa.string() if isinstance(stream.schema["conv_id"].dataType, StringType) else pa.int64()
    return stream.mapInArrow(run, f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, gaps bigint, blank bigint, duplicate bigint, "
                                  "truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
