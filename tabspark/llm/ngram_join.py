"""Documents linked by the Jaccard similarity of their five-word shingles: a T-occurrence join.

Two sets of sizes m and n are similar when they share at least ``T = 0.8 / 1.8 * (m + n)`` shingles: the
smaller list of each shared shingle must be met that often. As in DivideSkip, lists are divided:

* Equal sets are one class; the join works on a representative of each.
* Stars: classes that agree on a minimum hash are held against the first of them. Verified links make
  the large groups of near copies known, and from now on a group owns its shingles once.
* Short lists: of a set of n shingles, the ``n - ceil(0.8 n) + l`` smallest hashes are posted, with
  l = 1 + n / 20. Linked sets share at least l of these (the smaller l of the two). Postings meet by
  shingle, packed by hash range. Lists of at most ``SHORT`` owners are merged: their pairs are counted.
* Long lists are not merged; they only lower the wanted count by how many of them an owner is on. Pairs
  that reach the rest are candidates.
* An owner on so many long lists that nothing would be left to count is heavy. Heavy owners are joined
  with each other on whole sets, shingles ordered by how many owners have them, rare ones first,
  with the usual prefix and position bounds. This is the exact way for what the lists left out.
* Every candidate is verified by probing one whole sorted set with the other.
* Links inside a group of near copies are counted, not listed: members of a size class are dealt over blocks,
  and each two blocks whose sizes may agree are compared in one task, which returns a number a member.

So no link is lost, and no group of copies is expanded into its pairs. All lookups grow with the table: they are
shuffled and merged, or broadcast after a count of their cells, so the driver holds no more for more documents. Texts are looked up at
any size in one way: a sieve of the wanted ids, of bounded size, is broadcast, and only texts it lets through are shuffled. The components of the links are
found by alternating stars. Shingles are compared by 64-bit hashes.

A text of one to four words has one shingle, the whole sequence; one without words, or null, has none, and is
linked with nothing (its component is its own doc_id). Rows with a null doc_id take no part and have a null
component; rows that share a doc_id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tabspark.llm.common import frugal_group, joined, roomy, spread, stored
from tabspark.llm.components import components
from tabspark.llm.texts import hashes, parts, split_words

WORDS = 5
#: Bytes of text that are shingled at once.
SLICE_BYTES = 2 << 20
SHORT = 24
#: Postings of a range of shingles, about; a range is merged by one task.
POSTED = 400_000
#: A set of n shingles shares 1 + n // EXTRA posted ones with any set it is linked with.
EXTRA = 20
#: Minimum hashes by which classes meet for the stars.
KEYS = 3
#: Members of a star that one task holds against its centre.
STAR = 200
#: Shingles of a block of a group whose links are counted; a set counts as a thousand at least.
BLOCK = 1_000_000
#: Words of a sieve, and masks of 64 bits in each: 2 MB of bits at most.
SIEVE_WORDS, SIEVE_MASKS = 1 << 15, 8
#: Sizes of one class differ by this factor at most, so linked sets are in the same class or the next.
STEP = 1.26

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words = split_words(texts)
    own = hashes(words.distinct)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = max(len(own) - WORDS + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled = rolled * _ODD + own[k:k + n]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(words.begin[:-1].tolist(), words.begin[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a:b - WORDS + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in own[a:b]:
                h = h * _ODD + x
            out.append(_mixed(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n: int) -> int:
    """ceil(0.8 n): what a set of n shingles shares at least with one it is linked with."""
    return -(-4 * n // 5)


def _looked_up(texts: DataFrame, lookup: DataFrame, key: str, how: str) -> DataFrame:
    """The texts joined with a written lookup, ``inner`` or ``left``, on a key of a row each.

    Texts that a sieve of the lookup's keys holds back surely meet nothing and stay where they are; the others are shuffled.
    """
    hashed = F.xxhash64(key)
    slots = {"sieve_word": F.pmod(hashed, F.lit(SIEVE_WORDS)), "sieve_bit": F.pmod(F.shiftright(hashed, 20), F.lit(64 * SIEVE_MASKS))}
    mask, bit = F.expr("cast(sieve_bit div 64 as int)"), F.expr("shiftleft(1L, cast(sieve_bit % 64 as int))")
    masks = [f"sieve_{k}" for k in range(SIEVE_MASKS)]
    sieve = stored(lookup.select(key).withColumns(slots).groupBy("sieve_word").agg(
        *[F.coalesce(F.bit_or(F.when(mask == k, bit)), F.lit(0)).cast("bigint").alias(m) for k, m in enumerate(masks)]), "sieve")
    sieved = joined(texts.withColumns(slots), sieve, ["sieve_word"], how)
    through = F.coalesce(F.col(key).isNotNull() & (F.get(F.array(*masks), mask).bitwiseAND(bit) != 0), F.lit(False))
    met = sieved.where(through).select(*texts.columns).join(lookup.hint("merge"), key, how)
    if how == "inner":
        return met
    return met.unionByName(sieved.where(~through).select(*texts.columns), allowMissingColumns=True)


def _classes(docs: DataFrame, path_name: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest) of each row, and (digest, rep, n, k0...) of each class of equal sets."""
    def slim(batches):
        seeds = np.arange(1, KEYS + 1, dtype=np.uint64) * _ODD
        for batch in parts(batches, size=SLICE_BYTES):
            sets = shingles(batch.column("text"))
            keys = [[int(_mixed(s ^ seed).min().view(np.int64)) if len(s) else None for s in sets] for seed in seeds]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                                   *[pa.array(k, pa.int64()) for k in keys]], names=["doc_id", "n", "digest", *[f"k{i}" for i in range(KEYS)]])

    rows = stored(docs.mapInArrow(roomy(slim), "doc_id bigint, n bigint, digest binary, " + ", ".join(f"k{i} bigint" for i in range(KEYS))), path_name)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(KEYS)])
    return rows.select("doc_id", "n", "digest"), stored(classes, "classes")


def _stars(classes: DataFrame) -> DataFrame:
    """(x, y): each class and the first class with the same minimum hash."""
    keyed = classes.select(F.col("rep").alias("y"), F.posexplode(F.array(*[f"k{i}" for i in range(KEYS)])).alias("k", "h"))
    first = keyed.groupBy("k", "h").agg(F.min("y").alias("x"), F.count("y").alias("members")).where("members > 1").select("k", "h", "x")
    return keyed.join(first.hint("merge"), ["k", "h"]).where("x <> y").select("x", "y").distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of documents whose sets are similar, as (a, b).

    Only texts in a pair are read again. Each x is the centre of a star; the members of a large star
    are dealt over several tasks, and the centre's set goes to each.
    """
    pairs = stored(pairs, "pairs")
    salts = pairs.groupBy("x").agg(F.floor((F.count("y") - 1) / STAR).alias("last"))
    member = pairs.join(salts.hint("merge"), "x").select(F.col("y").alias("id"), "x", F.pmod(F.xxhash64("y"), F.col("last") + 1).alias("salt"))
    centre = salts.select(F.col("x").alias("id"), "x", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("salt"))
    roles = stored(member.unionByName(centre).groupBy("id").agg(F.collect_list(F.struct("x", "salt")).alias("stars")), "roles")
    rows = _looked_up(docs.withColumnRenamed("doc_id", "id"), roles, "id", "inner")

    def sets(batches):
        for batch in parts(batches, size=SLICE_BYTES):
            found = shingles(batch.column("text"))
            stars = batch.column("stars")
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(stars.offsets)))
            flat = stars.flatten()
            blobs = pa.array([s.tobytes() for s in found], pa.large_binary())
            take = pa.array(of, pa.int64())
            for low in range(0, len(of), 1000):
                part = take.slice(low, 1000)
                yield pa.record_batch([flat.field("x").slice(low, 1000), flat.field("salt").slice(low, 1000), batch.column("id").take(part),
                                       blobs.take(part).cast(pa.binary())], names=["x", "salt", "id", "set"])

    def compare(table: pa.Table) -> pa.Table:
        ids, centre_id = table["id"].to_pylist(), table["x"][0].as_py()
        held = {i: np.frombuffer(s.as_buffer(), "<u8") for i, s in zip(ids, table["set"].combine_chunks())}
        centre_set, linked = held.get(centre_id, np.zeros(0, np.uint64)), []
        for i, s in held.items():
            if i == centre_id or not len(s) or not len(centre_set):
                continue
            short, long = (s, centre_set) if len(s) <= len(centre_set) else (centre_set, s)
            if 5 * len(short) < 4 * len(long):
                continue
            # probe the longer sorted set by binary search
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            shared = int((long[at] == short).sum())
            if 100 * shared >= 80 * (len(short) + len(long) - shared):
                linked.append(i)
        return pa.table({"a": pa.array([centre_id] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    spreads = rows.select("id", "text", "stars").mapInArrow(roomy(sets), "x bigint, salt bigint, id bigint, set binary")
    return stored(spreads.groupBy("x", "salt").applyInArrow(frugal_group(compare), "a bigint, b bigint"), "links")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share; above the diagonal."""
    m = len(sets)
    tokens, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
    count = np.diff(edges)
    out = np.zeros(m * m, np.int64)
    for k in range(2, SHORT + 1):
        lists = edges[:-1][count == k]
        i, j = np.triu_indices(k, 1)
        for low in range(0, len(lists), 10_000):
            members = row[lists[low:low + 10_000, None] + np.arange(k)]
            out += np.bincount((members[:, i] * m + members[:, j]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    frequent = np.flatnonzero(count > SHORT)
    for low in range(0, len(frequent), 1024):
        lists = frequent[low:low + 1024]
        size = count[lists]
        at = np.repeat(edges[lists], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        has = np.zeros((m, len(lists)), np.float32)
        has[row[at], np.repeat(np.arange(len(lists)), size)] = 1
        out += (has @ has.T).astype(np.int64)
    return np.triu(out, 1)


def inner_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, links): the links of each of the members (id, n, owner) with others of the same owner."""
    count = members.groupBy("owner").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = members.join(count.hint("merge"), "owner")
    # two members are a group by their link
    pairs = members.where("size = 2").select(F.col("id").alias("node"), F.lit(1).cast("bigint").alias("links"))
    members = members.where("size > 2").withColumn("step", F.floor(F.log("n") / float(np.log(STEP))).cast("int"))
    steps = stored(members.groupBy("owner", "step").agg(
        F.count(F.lit(1)).alias("sets"), F.ceil(F.sum(F.greatest("n", F.lit(1000))) / BLOCK).cast("int").alias("blocks")), "steps")
    next_to = lambda by, name: steps.select("owner", (F.col("step") + by).alias("step"), F.col("blocks").alias(name))
    known = steps.join(next_to(-1, "above").hint("merge"), ["owner", "step"], "left").join(next_to(1, "below").hint("merge"), ["owner", "step"], "left")
    known = stored(known, "known-steps")
    dealt = members.join(known.hint("merge"), ["owner", "step"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def tasks(n, step, first, second, side, kind):
        """The tasks with each of n other blocks."""
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(
            F.concat_ws(":", F.col("owner"), step, first(o), second(o), F.lit(kind)).alias("task"), side(o).cast("int").alias("side")))).otherwise(
            F.array().cast("array<struct<task:string,side:int>>"))

    own = F.col("block")
    same = tasks(F.when(F.col("sets") > 1, F.col("blocks")), F.col("step"), lambda o: F.least(o, own), lambda o: F.greatest(o, own), lambda o: own > o, "same")
    above = tasks(F.col("above"), F.col("step"), lambda o: own, lambda o: o, lambda o: F.lit(0), "next")
    below = tasks(F.col("below"), F.col("step") - 1, lambda o: o, lambda o: own, lambda o: F.lit(1), "next")
    roles = stored(dealt.select("id", F.concat(same, above, below).alias("tasks")).where(F.size("tasks") > 0), "inner")
    rows = _looked_up(docs.withColumnRenamed("doc_id", "id"), roles, "id", "inner")

    def sets(batches):
        for batch in parts(batches, size=SLICE_BYTES):
            blobs = pa.array([s.tobytes() for s in shingles(batch.column("text"))], pa.large_binary())
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("tasks").offsets)))
            flat = batch.column("tasks").flatten()
            take = pa.array(of, pa.int64())
            for low in range(0, len(of), 1000):
                part = take.slice(low, 1000)
                yield pa.record_batch([flat.field("task").slice(low, 1000), flat.field("side").slice(low, 1000), batch.column("id").take(part),
                                       blobs.take(part).cast(pa.binary())], names=["task", "side", "id", "set"])

    def compare(table: pa.Table) -> pa.Table:
        held = {i: (side, np.frombuffer(s.as_buffer(), "<u8")) for i, side, s in zip(
            table["id"].to_pylist(), table["side"].to_pylist(), table["set"].combine_chunks())}
        _, _, first, second, kind = table["task"][0].as_py().split(":")
        side, n = np.array([x[0] for x in held.values()]), np.array([len(x[1]) for x in held.values()])
        shared = _shared([x[1] for x in held.values()])
        linked = (shared > 0) & (100 * shared >= 80 * (n[:, None] + n[None, :] - shared))
        if kind == "next" or first != second:
            linked &= side[:, None] != side[None, :]
        return pa.table({"node": pa.array(list(held), pa.int64()), "links": pa.array(linked.sum(0) + linked.sum(1), pa.int64())})

    met = rows.select("id", "text", "tasks").mapInArrow(roomy(sets), "task string, side int, id bigint, set binary")
    return pairs.unionByName(stored(met.groupBy("task").applyInArrow(frugal_group(compare), "node bigint, links bigint"), "inner-links"))


def _posted(docs: DataFrame, owners: DataFrame, ranges: int) -> DataFrame:
    """(a, b, n): pairs of owners and the short lists they share; with a null b, the long lists an owner is on."""
    rows = _looked_up(docs, owners, "doc_id", "left")
    rows = rows.select(F.when(F.col("skip").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("owner"), "text").where("owner is not null")

    def post(batches):
        for batch in parts(batches, size=SLICE_BYTES):
            heads = [s[:min(len(s) - least_shared(len(s)) + 1 + len(s) // EXTRA, len(s))].copy() for s in shingles(batch.column("text"))]
            lengths = [len(s) for s in heads]
            tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            owner = np.repeat(batch.column("owner").to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[new], owner[new]
            kind = "<u4" if len(owner) and owner.min() >= 0 and owner.max() < 1 << 32 else "<i8"
            of = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edges = np.searchsorted(of, np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(edges))
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([tokens[edges[i]:edges[i + 1]].tobytes() for i in full], pa.binary()),
                                   pa.array([owner[edges[i]:edges[i + 1]].astype(kind).tobytes() for i in full], pa.binary())], names=["range", "tokens", "owners"])

    def merge(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for c in table["tokens"].chunks for x in c])
        owner = np.concatenate([np.frombuffer(x.as_buffer(), "<u4" if 2 * len(x.as_buffer()) == len(t.as_buffer()) else "<i8").astype(np.int64)
                                for x, t in zip(table["owners"].combine_chunks(), table["tokens"].combine_chunks())])
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        count = np.diff(edges)
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, SHORT + 1):
            lists = edges[:-1][count == k]
            if len(lists):
                members = owner[lists[:, None] + np.arange(k)]
                i, j = np.triu_indices(k, 1)
                firsts.append(members[:, i].ravel())
                seconds.append(members[:, j].ravel())
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(a)))
        long_owner, long_times = np.unique(owner[np.repeat(count > SHORT, count)], return_counts=True)
        return pa.table({"a": pa.array(np.concatenate([a[start], long_owner]), pa.int64()),
                         "b": pa.concat_arrays([pa.array(b[start], pa.int64()), pa.nulls(len(long_owner), pa.int64())]),
                         "n": pa.array(np.concatenate([times, long_times]), pa.int64())})

    packed = rows.mapInArrow(roomy(post), "range int, tokens binary, owners binary")
    met = packed.groupBy("range").applyInArrow(frugal_group(merge), "a bigint, b bigint, n bigint")
    return stored(met.groupBy("a", "b").agg(F.sum("n").alias("n")), "met")


def _heavy(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs (x, y) among the given documents (doc_id, owner), of different owners: whole sets, rare shingles first."""
    rows = _looked_up(docs, members, "doc_id", "inner")

    def sets(batches):
        for batch in parts(batches, size=SLICE_BYTES):
            found = shingles(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("owner"),
                                   pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "owner", "tokens"])

    held = rows.select("doc_id", "owner", "text").mapInArrow(roomy(sets), "id bigint, owner bigint, tokens array<bigint>")
    held = stored(held.select("id", "owner", F.size("tokens").cast("bigint").alias("n"), F.explode("tokens").alias("token")).distinct(), "heavy")
    common = held.groupBy("token").agg(F.count_distinct("owner").alias("df")).where("df > 1")
    shared = held.join(common.hint("merge"), "token")
    # shingles of one owner alone come first in the order, and join nothing
    by_doc, whole = W.partitionBy("id").orderBy("df", "token"), W.partitionBy("id")
    placed = shared.withColumns({"rank": F.row_number().over(by_doc), "others": F.count(F.lit(1)).over(whole)})
    placed = placed.withColumn("at", F.col("n") - F.col("others") + F.col("rank") - 1).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 4 / 5))
    placed = stored(placed.select("token", "id", "owner", "n", "at"), "prefixes")
    x, y = placed.select([F.col(c).alias(f"x_{c}") for c in placed.columns]), placed.select([F.col(c).alias(f"y_{c}") for c in placed.columns])
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    near = (F.col("x_token") == F.col("y_token")) & (F.col("x_id") < F.col("y_id")) & (F.col("x_owner") != F.col("y_owner")) & (
        5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n")) & (180 * rest >= 80 * (F.col("x_n") + F.col("y_n")))
    return x.join(y.hint("merge"), near).select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct()


def shared_ids(docs: DataFrame) -> bool:
    """Whether some rows share their doc_id."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, links): a row for each row; ``links`` counts the other classes linked with its own.

    Every row is a document. Rows that share a doc_id are joined under numbers of their own, and a component is named
    by the smallest doc_id in it. Without ``counted`` there is no ``links``.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if not shared_ids(docs):
        return _join(docs, counted)
    own = stored(docs.withColumn("number", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "own-numbers")
    found = _join(own.select(F.col("number").alias("doc_id"), "text"), counted).withColumnRenamed("doc_id", "number")
    ids = own.select("number", "doc_id").where("number is not null")
    # a row without a doc_id has no number, and nothing to look up
    named = found.where("number is not null").join(ids.hint("merge"), "number")
    least = stored(named.groupBy("component_id").agg(F.min("doc_id").alias("least")), "least-ids")
    named = joined(named, least, ["component_id"], "inner")
    more = ["links"] if counted else []
    nameless = found.where("number is null").select(F.col("number").alias("doc_id"), "n_shingles", F.col("number").alias("component_id"), *more)
    return named.select("doc_id", "n_shingles", F.col("least").alias("component_id"), *more).unionByName(nameless)


def _join(docs: DataFrame, counted: bool) -> DataFrame:
    """The join of rows (doc_id, text) with doc_ids of their own, or null."""
    rows, classes = _classes(docs, "slim")
    links = verified(docs, _stars(classes))
    groups = stored(components(links), "groups") if links.take(1) else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # who owns a document's shingles: nobody if it is a copy, its group, or (not listed) the document itself
    copies = rows.where("n > 0 and doc_id is not null").select("doc_id").distinct().join(
        classes.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("bigint").alias("owner"))
    owners = copies.unionByName(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("owner"))).withColumn("skip", F.lit(True))
    # ranges of the hashes by the number of shingles posted, about a quarter of all
    total = classes.agg(F.sum("n")).first()[0] or 0
    met = _posted(docs, stored(owners, "owners"), max(4 * spread(docs.sparkSession), -(-total // (4 * POSTED))))
    # what is known of each owner: its smallest l, its sizes, and the long lists it is on
    members = stored(classes.select(F.col("rep").alias("id"), "n").join(groups.withColumnRenamed("node", "id").hint("merge"), "id", "left").select(
        "id", "n", F.coalesce("component", "id").alias("owner")), "members")
    long = met.where("b is null").select(F.col("a").alias("owner"), F.col("n").alias("long"))
    known = members.groupBy("owner").agg(F.min("n").alias("low"), F.max("n").alias("high")).join(long.hint("merge"), "owner", "left").select(
        "owner", "low", "high", F.coalesce("long", F.lit(0)).alias("long"))
    # linked owners differ in size by a quarter at most, so both are on at least this many long lists if only those are shared
    known = stored(known.withColumn("heavy", F.col("long") >= 1 + F.floor(F.col("low") * 4 / 5 / EXTRA)), "known")
    pairs = met.where("b is not null").join(known.select([F.col(c).alias(f"a_{c}") for c in known.columns]).hint("merge"), F.col("a") == F.col("a_owner")).join(
        known.select([F.col(c).alias(f"b_{c}") for c in known.columns]).hint("merge"), F.col("b") == F.col("b_owner"))
    wanted = 1 + F.floor(F.least("a_low", "b_low") / EXTRA) - F.least("a_long", "b_long")
    # two heavy owners are left to the join on whole sets
    pairs = pairs.where(~(F.col("a_heavy") & F.col("b_heavy")) & (F.col("n") >= wanted) & (5 * F.col("a_high") >= 4 * F.col("b_low")) & (5 * F.col("b_high") >= 4 * F.col("a_low")))
    x, y = members.select(F.col("id").alias("x"), F.col("owner").alias("a"), F.col("n").alias("x_n")), members.select(
        F.col("id").alias("y"), F.col("owner").alias("b"), F.col("n").alias("y_n"))
    light = pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n")).select("x", "y")
    heavy = known.where("heavy").select("owner")
    heavy = stored(members.join(heavy.hint("merge"), "owner", "left_semi").select(F.col("id").alias("doc_id"), "owner"), "heavy-members")
    across = verified(docs, light.unionByName(_heavy(docs, heavy)).distinct())
    links = stored(links.unionByName(across).distinct(), "all-links")
    whole = components(links) if links.take(1) else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    of_class = classes.select("digest", F.col("rep").alias("node")).join(whole.hint("merge"), "node", "left")
    if counted:
        ends = across.select(F.col("a").alias("node")).unionByName(across.select(F.col("b").alias("node"))).withColumn("links", F.lit(1).cast("bigint"))
        degree = ends.unionByName(inner_links(docs, members)).groupBy("node").agg(F.sum("links").alias("links"))
        of_class = of_class.join(degree.hint("merge"), "node", "left")
    more = ["links"] if counted else []
    of_class = of_class.select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"), *more)
    out = rows.join(of_class.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                     *[F.coalesce(c, F.lit(0)).alias(c) for c in more])
    return stored(out, "joined")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each component kept, with their own columns.

    Every row is a document and judged by its own text. Of a component the row with the smallest doc_id stays, of those the one
    with the smallest hash. Rows without shingles or doc_id are copies of nothing and stay.
    """
    number = F.col("doc_id").cast("bigint")
    shared = shared_ids(docs)
    if shared:
        number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = docs.select(F.struct(*docs.columns).alias("row"), number.alias("id"), F.xxhash64(*docs.columns).alias("hash"), "text")
    if shared:
        rows = stored(rows, "own-numbers")
    found = _join(rows.select(F.col("id").alias("doc_id"), "text"), False).where("n_shingles > 0 and doc_id is not null")
    found = found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("component"))
    if shared:
        order = F.struct(F.col("row.doc_id").cast("bigint").alias("doc_id"), "hash", "id")
        first = found.join(rows.select("id", order.alias("order")).hint("merge"), "id").groupBy("component").agg(F.min("order").alias("first"))
        copies = joined(found, stored(first.select("component", F.col("first.id").alias("kept")), "kept-rows"), ["component"], "inner")
        copies = copies.where("id <> kept")
    else:
        copies = found.where("id <> component")
    copies = stored(copies.select("id", F.lit(True).alias("copy")), "copies")
    return _looked_up(rows.drop("text"), copies, "id", "left").where("copy is null").select("row.*")
