"""CSV and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabspark.functions.columns import agg_row, col, nan_to_null
from tabspark.sources.records import split_records

# Texts that mean "missing" in a CSV file.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_WHOLE = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"
_BOOL = ("True", "False", "TRUE", "FALSE", "true", "false")


def read_csv(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS, multiline: bool | None = None) -> DataFrame:
    """CSV with a header; missing-value texts become NULL and each column gets the narrowest
    of bigint, boolean, double and string that fits all its values.

    One aggregate over the text decides all types. A whole-number column with gaps stays
    bigint. Unless ``multiline`` says so, a scan of the lines finds out whether any quoted
    value has a line break (a line with an odd number of quotes). Only then are records put together
    from lines of all splits; otherwise Spark's reader takes them as they are.
    """
    if multiline is None:
        lines = spark.read.text(path)
        odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = lines.filter(odd % 2 == 1).limit(1).count() > 0
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    text = _from_records(spark, path, reader.option("multiLine", True).csv(path).columns) if multiline else reader.csv(path)
    raw = text.select([F.when(~col(c).isin(*na_tokens), col(c)).alias(c) for c in text.columns])
    exprs = {}
    for c in raw.columns:
        v = col(c)
        exprs[c, "any"] = F.count(v)
        exprs[c, "whole"] = F.count(F.when(v.rlike(_WHOLE), v.try_cast("bigint")))
        exprs[c, "number"] = F.count(F.when(v.rlike(_NUMBER), F.lit(1)))
        exprs[c, "bool"] = F.count(F.when(v.isin(*_BOOL), F.lit(1)))
    seen = agg_row(raw, exprs)
    typed = []
    for c in raw.columns:
        n = seen[c, "any"]
        if n == 0 or n == seen[c, "number"] and n != seen[c, "whole"]:
            kind = "double"                      # a column without any value is numeric, all missing
        elif n == seen[c, "whole"]:
            kind = "bigint"
        elif n == seen[c, "bool"]:
            kind = "boolean"
        else:
            kind = "string"
        value = col(c) if kind == "string" else F.trim(col(c)).try_cast(kind)
        typed.append(value.alias(c))
    return raw.select(typed)


def _from_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """All columns as texts, from records that may hold line breaks; the first record of each file is its header."""
    records = split_records(spark, path)
    heads = records.groupBy("file").agg(F.min(F.struct("split", "at")).alias("head"))
    rows = records.join(heads, "file").where((F.col("split") != F.col("head.split")) | (F.col("at") != F.col("head.at")))
    rows = rows.where(F.length(F.trim("record")) > 0)
    places = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    parsed = F.from_csv("record", places.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("_r")).select([F.col(f"_r._{i}").alias(n) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with headers; missing values are empty fields."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with NaN read as missing."""
    return nan_to_null(spark.read.parquet(path))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, copies counted (order ignored)."""
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    left = signed.groupBy(*[col(c) for c in a.columns]).agg(F.sum("_s").alias("_s")).filter("_s <> 0")
    return left.limit(1).count() == 0
