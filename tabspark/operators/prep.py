"""Feature preparation: imputation, scaling, ordinal codes, label codes, schema alignment."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.functions.columns import agg_row, classify_columns, col, number, present
from tabspark.operators.clean import apply_fills, with_columns
from tabspark.operators.counting import modes, value_counts_long
from tabspark.operators.quantiles import quantiles
from tabspark.session import scratch_path, shared_dir

LITERAL_VALUES = 64         # categories kept as a CASE over literals
LISTED_VALUES = 1_000       # categories kept in the model itself
BROADCAST_VALUES = 200_000  # dictionary rows up to which it is broadcast ...
BROADCAST_CHARS = 20_000_000    # ... if its text is not longer than this
HEAVY = 200                 # values that are kept out of a shuffle join's keys
UNSEEN = -1.0
GAP = "\x00gap"            # stands for a missing value in a shuffle; no dictionary has it


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns a model reads, in table order, and how."""
    target: str
    features: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    ignored: tuple[str, ...]
    types: tuple[str, ...]

    @classmethod
    def from_df(cls, df: DataFrame, target: str, exclude: Sequence[str] = ()) -> "FeatureSpec":
        """All columns but the target and the excluded ones (row ids) are features."""
        names = [c for c in df.columns if c != target and c not in exclude]
        kinds = classify_columns(df.select([col(c) for c in names]).schema)
        return cls(target, tuple(names), kinds.numeric, kinds.categorical, kinds.ignored,
                   tuple(df.schema[c].dataType.simpleString() for c in names))

    @property
    def vector_names(self) -> list[str]:
        """Names of the vector slots: numeric block, then categorical block."""
        return [*self.numeric, *self.categorical]


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    medians = quantiles(df, cols, (0.5,))
    return with_columns(df, {c: F.coalesce(number(df, c), F.lit(medians[c][0])) for c in cols})


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_fills(df, modes(df, cols))


def scale_pop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    exprs = {}
    for c in cols:
        exprs[c, "mean"], exprs[c, "std"] = F.avg(number(df, c)), F.stddev_pop(number(df, c))
    got = agg_row(df, exprs)
    return with_columns(df, {c: _scaled(number(df, c), got[c, "mean"], got[c, "std"]) for c in cols})


def _scaled(value: Column, mean: float | None, std: float | None) -> Column:
    return (value - F.lit(float(mean or 0.0))) / F.lit(float(std) if std else 1.0)


def ordinal_encode(df: DataFrame, cols: Sequence[str], learn_from: DataFrame | None = None, listed: int | None = None,
                   broadcast: int | None = None) -> DataFrame:
    """Codes 0..K-1 in sorted order of the values; unseen values (and missing) get -1.

    ``listed`` and ``broadcast`` bound the dictionaries that are held in the plan and sent to all tasks; larger ones are joined.
    """
    books = learn_codes(df if learn_from is None else learn_from, cols, listed)[0]
    return apply_codes(df, books, broadcast=broadcast)


def _text(df: DataFrame, c: str) -> Column:
    return col(c).cast("string")


def learn_codes(df: DataFrame, cols: Sequence[str], most_listed: int | None = None) -> tuple[list[dict], dict[str, str | None]]:
    """Per column its dictionary, and its mode, both from one count of the values.

    Small dictionaries become lists. A larger one is written to the shared folder as a table
    (value, code) whose codes are numbered by the tasks themselves.
    """
    if not cols:
        return [], {}
    texts = df.select([_text(df, c).alias(c) for c in cols])
    counted, _ = value_counts_long(texts, cols)
    counted = counted.withColumnRenamed("v0", "value").persist()
    try:
        stats = {r["c"]: r for r in counted.groupBy("c").agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.length("value")).alias("chars"),
            F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best")).collect()}
        listed = [i for i, r in stats.items() if r["k"] <= (LISTED_VALUES if most_listed is None else most_listed)]
        values: dict[int, list[str]] = {}
        for r in counted.filter(F.col("c").isin(listed)).orderBy("c", "value").collect() if listed else ():
            values.setdefault(r["c"], []).append(r["value"])      # at most most_listed per column
        books, best = [], {}
        for i, c in enumerate(cols):
            known = stats.get(i)
            best[c] = known["best"]["value"] if known else None
            book = {"name": c, "size": known["k"] if known else 0, "values": values.get(i, [])}
            if known and i not in values:
                one = counted.filter(F.col("c") == i).select("value", "n")
                book.update(values=None, chars=known["chars"], table=_write_codes(one))
            books.append(book)
        return books, best
    finally:
        counted.unpersist()


def _write_codes(counted: DataFrame) -> str:
    spark = counted.sparkSession
    shared_dir(spark)
    ordered = counted.repartitionByRange("value").sortWithinPartitions("value").checkpoint()
    placed = ordered.withColumn("pid", F.spark_partition_id()).withColumn(
        "pos", F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1)))
    sizes = dict(placed.groupBy("pid").count().collect())         # one row per partition
    start, starts = 0, []
    for pid in sorted(sizes):
        starts.append((pid, start))
        start += sizes[pid]
    offsets = spark.createDataFrame(starts, "pid int, start long")
    path = scratch_path(spark, "codes")
    (placed.join(F.broadcast(offsets), "pid")
     .select("value", (F.col("start") + F.col("pos")).cast("double").alias("code"))
     .write.parquet(path))
    return path


def apply_codes(df: DataFrame, books: Sequence[dict], fills: dict[str, str | None] | None = None,
                broadcast: int | None = None) -> DataFrame:
    """Replace the columns by their codes; gaps are first given the value in ``fills``."""
    fills, literal = fills or {}, {}
    out = df
    for book in books:
        c = book["name"]
        text = F.coalesce(_text(df, c), F.lit(fills.get(c)).cast("string"))
        if book["values"] is not None and len(book["values"]) <= LITERAL_VALUES:
            code = F.lit(UNSEEN)
            for i, value in enumerate(book["values"]):
                code = F.when(text == F.lit(value), F.lit(float(i))) if i == 0 else code.when(
                    text == F.lit(value), F.lit(float(i)))
            literal[c] = code.otherwise(F.lit(UNSEEN)) if book["values"] else code
    if literal:
        out = with_columns(out, literal)
    for book in books:
        if book["name"] not in literal:
            out = _lookup(out, book, fills.get(book["name"]), broadcast)
    return out


def heavy_values(df: DataFrame, column: str) -> list[str]:
    """The values that many rows have, as far as they can unbalance a shuffle: at most HEAVY of them, the most frequent first.

    Each task counts with a bounded table, from which rare values are dropped when it is full, and returns what it has often.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                if pair["values"] is not None:
                    held[pair["values"]] += pair["counts"]
            if len(held) > 64 * HEAVY:
                held = Counter(dict(held.most_common(16 * HEAVY)))
        often = [(v, n) for v, n in held.most_common(HEAVY) if n * 4 * HEAVY >= rows]
        yield pa.record_batch([pa.array([v for v, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["value", "n"])

    found = df.select(col(column).cast("string").alias("value")).mapInArrow(count, "value string, n bigint")
    top = found.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(HEAVY).collect()
    return [r["value"] for r in top]


def _lookup(df: DataFrame, book: dict, fill: str | None, broadcast: int | None) -> DataFrame:
    c, spark = book["name"], df.sparkSession
    keyed = df.withColumn("_text", F.coalesce(_text(df, c), F.lit(fill).cast("string")))
    if book["values"] is not None:
        table = spark.createDataFrame([(v, float(i)) for i, v in enumerate(book["values"])], "_text string, _code double")
        keyed = keyed.join(F.broadcast(table), "_text", "left")
    else:
        table = spark.read.parquet(book["table"]).withColumnsRenamed({"value": "_text", "code": "_code"})
        if book["size"] <= (BROADCAST_VALUES if broadcast is None else broadcast) and book["chars"] <= BROADCAST_CHARS:
            keyed = keyed.join(F.broadcast(table), "_text", "left")
        else:
            # frequent values and gaps do not meet in one task: their rows are dealt out, and the few entries of
            # the dictionary that they need are sent along
            heavy = [] if df.isStreaming else heavy_values(keyed, "_text")
            loose = F.col("_text").isNull() | F.col("_text").isin(heavy)
            dealt = F.concat(F.lit(GAP), F.pmod(F.xxhash64(*[F.xxhash64(col(n)) for n in df.columns]), F.lit(1000)).cast("string"))
            few = table.filter(F.col("_text").isin(heavy)).withColumnsRenamed({"_text": "_known", "_code": "_early"})
            keyed = keyed.join(F.broadcast(few), F.col("_text") == F.col("_known"), "left").drop("_known")
            keyed = keyed.withColumn("_text", F.when(loose, dealt).otherwise(F.col("_text"))).join(table, "_text", "left")
            keyed = keyed.withColumn("_code", F.coalesce("_early", "_code"))
    coded = F.coalesce(F.col("_code"), F.lit(UNSEEN))
    return keyed.select([coded.alias(n) if n == c else col(n) for n in df.columns])


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)


class TablePrep(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the whole preparation of a table in a handful of jobs, however many columns.

    Numeric: median for gaps, then mean and population std. Categorical: mode for gaps, then
    ordinal codes. The model adds ``features``, a vector of the numeric block and then the
    categorical one, and ``_x``, the same as an array; whichever is not used costs nothing.
    Codes are used as plain numbers.
    """

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TablePrepModel":
        numeric = self.getOrDefault(self.numericCols)
        medians = quantiles(df, numeric, (0.5,))
        exprs = {}
        for c in numeric:
            filled = F.coalesce(number(df, c), F.lit(medians[c][0] or 0.0))
            exprs[c, "mean"], exprs[c, "std"] = F.avg(filled), F.stddev_pop(filled)
        got = agg_row(df, exprs)
        books, best = learn_codes(df, self.getOrDefault(self.categoricalCols))
        state = {"numeric": [{"name": c, "median": medians[c][0] or 0.0, "mean": got[c, "mean"] or 0.0,
                              "std": got[c, "std"] or 1.0} for c in numeric],
                 "categorical": books, "modes": best}
        return TablePrepModel(state=json.dumps(state))


class TablePrepModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "what was learned, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def learned(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def prepared_columns(self, df: DataFrame) -> DataFrame:
        """The table with its feature columns imputed, scaled and coded, before assembly."""
        learned = self.learned
        new = {s["name"]: _scaled(F.coalesce(number(df, s["name"]), F.lit(float(s["median"]))), s["mean"], s["std"])
               for s in learned["numeric"]}
        return apply_codes(with_columns(df, new), learned["categorical"], learned["modes"])

    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.learned
        names = [s["name"] for s in learned["numeric"]] + [b["name"] for b in learned["categorical"]]
        if not names:
            raise ValueError("there are no numeric or categorical features")
        # prepared copies live beside the originals, under names no CSV header has
        copies = df.select("*", *[col(n).alias(f"_f_{i}") for i, n in enumerate(names)])
        renamed = {**learned,
                   "numeric": [{**s, "name": f"_f_{i}"} for i, s in enumerate(learned["numeric"])],
                   "categorical": [{**b, "name": f"_f_{len(learned['numeric']) + i}"}
                                   for i, b in enumerate(learned["categorical"])],
                   "modes": {f"_f_{names.index(c)}": v for c, v in learned["modes"].items()}}
        ready = TablePrepModel(state=json.dumps(renamed)).prepared_columns(copies)
        array = F.array(*[F.col(f"_f_{i}").cast("double") for i in range(len(names))])
        return ready.select(*[col(c) for c in df.columns], array.alias("_x"), array_to_vector(array).alias("features"))


def build_prep(spec: FeatureSpec) -> TablePrep:
    return TablePrep(numericCols=list(spec.numeric), categoricalCols=list(spec.categorical))


@dataclass(frozen=True)
class LabelCodec:
    """Sorted classes <-> 0..N-1."""
    classes: tuple
    dtype: str

    @classmethod
    def fit(cls, df: DataFrame, target: str) -> "LabelCodec":
        """All classes of the target, which the model has to hold in any case."""
        counted, fields = value_counts_long(df, [target])
        rows = counted.select(fields[0]).orderBy(fields[0]).collect()
        return cls(tuple(r[0] for r in rows), df.schema[target].dataType.simpleString())

    def encode(self, value: Column) -> Column:
        """Class index as double; NULL for a value that is no class."""
        code = F.when(F.lit(False), F.lit(0.0))
        for i, c in enumerate(self.classes):
            code = code.when(value == F.lit(c), F.lit(float(i)))
        return code

    def decode(self, index: Column) -> Column:
        labels = F.array(*[F.lit(c).cast(self.dtype) for c in self.classes])
        return F.element_at(labels, index.cast("int") + 1)


def align(df: DataFrame, features: Sequence[str], types: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order: missing ones are NULL, others dropped."""
    here = set(df.columns)
    cells = [(present(df, c).try_cast(t) if c in here and df.schema[c].dataType.simpleString() != t else
              col(c) if c in here else F.lit(None).cast(t)).alias(c)
             for c, t in zip(features, types)]
    return df.select(*[col(k) for k in keep if k not in features], *cells)
