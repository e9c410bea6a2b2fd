"""The registry of queries over the test tables, and the tables several of them share.

A query is a function of (spark, folder). Where DuckDB can compute the same rows, its SQL
stands beside it. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.functions.hashing import bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Round the double columns, so that the order of float additions does not show."""
    chosen = set(cols) or {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select([F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])


# Missing values that the tables imply: an 'error' event carries no value, and only some
# documents have labels.

EVENTS = "(SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


DOCS = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, folder, "labels"), "doc_id", "left")


def sql_hash(salt: str, *cols: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(cols)})), 1, 8))::BIGINT)"


# A target with a known signal: the price of an order and its customer's balance, plus noise
# from a hash of the key.

_NOISE = f"({sql_hash('noise', 'o_orderkey')} % 10000) / 10000.0"
SIGNAL = (f"(SELECT o_orderkey, o_totalprice, o_orderpriority, c_acctbal, c_mktsegment, "
          f"o_totalprice / 10000 - c_acctbal / 500 + ({_NOISE} - 0.5) * 4 AS y "
          f"FROM orders JOIN customer ON o_custkey = c_custkey)")


def signal(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    noise = bucket(o, ["o_orderkey"], "noise") / 10000
    joined = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", noise.alias("noise")).join(
        c.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    y = F.col("o_totalprice") / 10000 - F.col("c_acctbal") / 500 + (F.col("noise") - 0.5) * 4
    return joined.select("o_orderkey", "o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", y.alias("y"))


FEATURES = ["o_totalprice", "c_acctbal"]


def signal_classes(spark: SparkSession, folder: str, classes: int = 2) -> DataFrame:
    """The same rows with a class instead of y: below, (between) and above fixed limits."""
    s = signal(spark, folder)
    label = (F.col("y") > 15).cast("int") if classes == 2 else (F.col("y") > 8).cast("int") + (F.col("y") > 20).cast("int")
    return s.withColumn("label", label).drop("y")
