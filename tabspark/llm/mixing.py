"""A mix of sources with given weights, laid out slot by slot.

The mix has as many words as all documents together. Sources, by code point with null last,
weigh 1, 2, 3 and so on in turn; a source's target stops at three times its words and what is
over is shared by the others by weight. The mix is a row of slots of equal length. Slot k lies
at the golden-ratio point frac(k * 0.618...), and the source whose interval of cumulative
targets holds that point fills it; so every stretch of the mix has nearly the wanted shares.
The r-th slot of a source takes the r-th block of that source's words, its documents standing
in shuffled order and being read up to three times over.

Everything is joins, windows and sums; nothing depends on how rows are dealt out. A document
without words takes no part in the mix (``taken`` 0); a null source is a source; repeated rows
are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabspark.llm.common import SLICES, SLIM_ROWS, WORD, joined, ranged, running, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words of a slot.
BLOCK = 64
#: Slots whose ranks are counted together first.
CHUNK = 1 << 16
#: The golden-ratio points are whole numbers below 2**31: k times the odd number nearest to 2**31 / 1.618..., modulo 2**31.
POINTS = 1 << 31
GOLDEN = 1327217885
#: Intervals of sources are found through this many cells.
CELLS = 4096


def _up(n: Column) -> Column:
    return F.ceil(n).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, words) to (source, sid, source_size, target, low, high): intervals of points in source order."""
    by_name = ranged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), ["source"], "sources")
    one = running(by_name, [], [F.col("part"), F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    one = one.drop("part").withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_fill = ranged(one.withColumn("fill", F.col("cap") / F.col("weight")), ["fill", "sid"], "fills")
    two = running(by_fill, [], [F.col("part"), F.col("fill"), F.col("sid")], {"caps": "cap", "gone": "weight"})
    total = by_fill.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    two = two.withColumns({"words": total.select("words").scalar(), "weights": total.select("weights").scalar()})
    level = (F.col("words") - F.col("caps")) / (F.col("weights") - F.col("gone"))
    two = stored(two.withColumn("level", level), "levels")
    # sources that fill up before the common level stop at their cap; the first that does not gives the level
    common = two.where(F.col("fill") >= F.col("level") * (1 - 1e-12)).agg(F.min_by("level", F.struct("fill", "sid")).alias("common"))
    three = stored(two.withColumn("target", F.least(F.col("cap"), F.coalesce(common.scalar(), F.lit(0.0)) * F.col("weight"))), "targets")
    parted = ranged(three.select("source", "sid", "source_size", "target", "words"), ["sid"], "intervals")
    four = running(parted, [], [F.col("part"), F.col("sid")], {"before": "target"})
    point = lambda words: F.round(words / F.col("words") * POINTS).cast("bigint")
    return stored(four.select("source", "sid", "source_size", "target", "words", F.when(F.col("words") > 0, point(F.col("before"))).alias("low"),
                              F.when(F.col("words") > 0, point(F.col("before") + F.col("target"))).alias("high")), "shares")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank): which block of which source stands in each slot."""
    spark = targets.sparkSession
    slots = -(-(targets.agg(F.max("words")).first()[0] or 0) // block)
    width = POINTS // CELLS
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS))
    rows = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    cells = stored(targets.where("high > low").select(
        "sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")), "cells")
    rows = joined(rows, cells, ["cell"], "inner").where("point >= low and point < high").select("slot", "sid")
    rows = rows.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    return running(rows, ["sid"], [F.col("chunk"), F.col("slot")], {"rank": F.lit(1).cast("bigint")}).select("slot", "sid", "rank")


def mix(docs: DataFrame, source: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",),
        block: int = BLOCK, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Each row with its size, its source's size and target and the words taken, and the mix itself.

    The mix is (slot, sid, row id, pass, words): the pieces of documents that stand in each slot.
    """
    # the same order on every run: by hashes of the row, its text included
    sized = stored(docs.select(
        F.struct(*keep).alias("row"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit("mix"), *keep, text).alias("turn"), F.xxhash64(text, *keep).alias("tie")), "sized")
    targets = source_targets(sized.select("source", "size"))
    rows = joined(sized, targets.select("source", "sid", "source_size", "target", "words"), ["source"])
    placed = running(rows, ["sid"], [F.pmod("turn", F.lit(SLICES)), F.col("turn"), F.col("tie")],
                     {"at": "size", "place": F.lit(1).cast("bigint")})
    placed = stored(placed.drop("turn", "tie", "source"), "placed")
    passes = F.least(F.lit(most - 1).cast("bigint"), F.floor((F.col("target") + 2 * block) / F.col("source_size")))
    pieces = placed.where("size > 0").select("sid", "place", "size", "at", "source_size", F.explode(F.sequence(F.lit(0).cast("bigint"), passes)).alias("pass"))
    pieces = pieces.withColumn("start", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("end", F.col("start") + F.col("size"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    inside = F.least(F.col("end"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block)
    mixed = pieces.select("sid", "rank", "place", "pass", inside.alias("words")).join(schedule(targets, block), ["sid", "rank"])
    taken = mixed.groupBy("sid", "place").agg(F.sum("words").alias("taken"))
    report = placed.drop("at", "words").join(taken, ["sid", "place"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    return report, mixed


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix repeats them: each as often as it takes the document's words, rounded.

    The mix is planned without texts, by a hash of each row; rows alike in everything get the same number, their mean.
    A document without words stays as it is.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("key"), F.col("source").alias("source"), F.col("text").alias("text"))
    report, _ = mix(keyed, keep=("key",))
    share = F.when(F.sum("size") > 0, F.sum("taken") / F.sum("size")).otherwise(1)
    times = stored(report.groupBy("row.key").agg(F.floor(share + 0.5).cast("int").alias("times")), "times")
    return joined(keyed, times, ["key"], "inner", SLIM_ROWS).withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
