"""Queries: sources, cleaning, preparation and splits."""

from pyspark.sql import functions as F

from tabspark.catalog.base import DOCS, EVENTS, docs, events, query, rounded, sql_hash, table
from tabspark.operators import clean, prep, splits
from tabspark.plans.recipe import Recipe
from tabspark.session import scratch_path
from tabspark.sources import tables

_CLIP = ("least(greatest({c}, (SELECT quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t})), "
         "(SELECT quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {t}))")


def _clip(c: str, t: str, k: float = 1.5) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN round({_CLIP.format(c=c, t=t, k=k)}, 6) END"


@query("csv_roundtrip", f"SELECT event_id, user_id, event_type, value FROM {EVENTS}")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_csv(events(spark, folder), path)
    return tables.read_csv(spark, path)


@query("csv_customer", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_customer(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_csv(table(spark, folder, "customer"), path)
    return tables.read_csv(spark, path)


@query("csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, folder):
    """Texts with line breaks and quotes survive the round trip whole."""
    path = scratch_path(spark, "csv")
    tables.write_csv(table(spark, folder, "documents"), path)
    return tables.read_csv(spark, path)


@query("parquet_roundtrip", f"SELECT doc_id, lang, source, n_chars, quality, toxic FROM {DOCS}")
def parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "parquet")
    tables.write_parquet(docs(spark, folder), path)
    return tables.read_parquet(spark, path)


@query("drop_sparse", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_sparse(spark, folder):
    return clean.drop_sparse_columns(docs(spark, folder), 50)


@query("clip_outliers", f"SELECT event_id, user_id, event_type, {_clip('value', EVENTS)} AS value FROM {EVENTS}")
def clip_outliers(spark, folder):
    return rounded(clean.clip_outliers(events(spark, folder), ["value"]))


@query("clip_all_numeric", f"""
SELECT {_clip('event_id::DOUBLE', EVENTS)} AS event_id, {_clip('user_id::DOUBLE', EVENTS)} AS user_id, event_type,
       {_clip('value', EVENTS, 1.0)} AS value FROM {EVENTS}""")
def clip_all_numeric(spark, folder):
    wide = clean.clip_outliers(events(spark, folder), ["event_id", "user_id"])
    return rounded(clean.clip_outliers(wide, ["value"], 1.0))


@query("fill_median", f"""
SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS})), 6) AS value
FROM {EVENTS}""")
def fill_median(spark, folder):
    return rounded(clean.fill_missing(events(spark, folder), {"value": "median"}))


@query("fill_mean", f"""
SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT avg(value) FROM {EVENTS})), 6) AS value FROM {EVENTS}""")
def fill_mean(spark, folder):
    return rounded(clean.fill_missing(events(spark, folder), {"value": "mean"}))


def _mode(c: str, source: str) -> str:
    return (f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("fill_mode", f"""
SELECT event_id, user_id, event_type, coalesce(value, {_mode('value', EVENTS)}) AS value FROM {EVENTS}""")
def fill_mode(spark, folder):
    return clean.fill_missing(events(spark, folder), {"value": "mode"})


_TEXT = f"(SELECT doc_id, CASE WHEN quality = 1 THEN lang END AS lang, quality, toxic FROM {DOCS})"


def _labelled_lang(spark, folder):
    return docs(spark, folder).select("doc_id", F.when(F.col("quality") == 1, F.col("lang")).alias("lang"),
                                      "quality", "toxic")


@query("fill_mode_text", f"""
SELECT doc_id, coalesce(lang, {_mode('lang', _TEXT)}) AS lang, coalesce(quality, {_mode('quality', _TEXT)}) AS quality,
       coalesce(toxic, {_mode('toxic', _TEXT)}) AS toxic FROM {_TEXT}""")
def fill_mode_text(spark, folder):
    return clean.fill_missing(_labelled_lang(spark, folder), {"lang": "mode", "quality": "mode", "toxic": "mode"})


@query("fill_constant", f"""
SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic FROM {_TEXT}""")
def fill_constant(spark, folder):
    return clean.fill_missing(_labelled_lang(spark, folder), dict.fromkeys(("lang", "quality", "toxic"), "constant"),
                              {"toxic": -1})


_FORMULAS = {
    "unit_price": "l_extendedprice * (1 - l_discount) / l_quantity", "squared": "-(l_quantity + l_linenumber) ** 2",
    "per_discount": "l_quantity / l_discount", "zero_safe": "(l_linenumber - 1) / l_discount",
    "cubed": "l_linenumber ** 3"}


@query("derive_formula", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / l_quantity AS unit_price,
       -((l_quantity + l_linenumber) * (l_quantity + l_linenumber)) AS squared,
       CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity / l_discount END AS per_discount,
       CASE WHEN l_linenumber = 1 AND l_discount = 0 THEN NULL
            WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE (l_linenumber - 1) / l_discount END AS zero_safe,
       (l_linenumber * l_linenumber * l_linenumber)::BIGINT AS cubed
FROM lineitem""")
def derive_formula(spark, folder):
    lines = table(spark, folder, "lineitem")
    for name, formula in _FORMULAS.items():
        lines = clean.derive(lines, name, formula)
    return lines.select("l_orderkey", "l_linenumber", *_FORMULAS)


def _recipe() -> Recipe:
    return (Recipe().drop_sparse_columns(50).clip_outliers(["value"]).fill_missing({"value": "median"})
            .derive("value_by_user", "value * user_id / 7"))


_REPLAY = f"""
WITH clipped AS (SELECT event_id, user_id, event_type, CASE WHEN value IS NOT NULL THEN
                   {_CLIP.format(c='value', t=EVENTS, k=1.5)} END AS value FROM {EVENTS}),
filled AS (SELECT event_id, user_id, event_type,
                  coalesce(value, (SELECT quantile_cont(value, 0.5) FROM clipped)) AS value FROM clipped)
SELECT event_id, user_id, event_type, round(value, 6) AS value, round(value * user_id / 7, 6) AS value_by_user FROM filled"""


@query("recipe_replay", _REPLAY)
def recipe_replay(spark, folder):
    return rounded(Recipe.from_json(_recipe().to_json()).apply(events(spark, folder)))


@query("recipe_frozen", _REPLAY)
def recipe_frozen(spark, folder):
    """Learned once, stored as JSON, then applied without looking at the data again."""
    raw = events(spark, folder)
    frozen = Recipe.from_json(_recipe().fit(raw).to_json())
    return rounded(frozen.apply(raw))


@query("recipe_reset", f"""
SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT avg(value) FROM {EVENTS})), 6) AS value FROM {EVENTS}""")
def recipe_reset(spark, folder):
    steps = _recipe().drop_derived("value_by_user").reset().fill_missing({"value": "mean"})
    return rounded(steps.apply(events(spark, folder)))


@query("drop_null_target", f"SELECT * FROM {DOCS} WHERE quality IS NOT NULL")
def drop_null_target(spark, folder):
    return clean.drop_null_target(docs(spark, folder), "quality")


@query("impute_median", f"""
SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM {DOCS}))::DOUBLE AS quality FROM {DOCS}""")
def impute_median(spark, folder):
    return prep.impute_median(docs(spark, folder).select("doc_id", "quality"), ["quality"])


@query("impute_mode", f"SELECT doc_id, coalesce(lang, {_mode('lang', _TEXT)}) AS lang FROM {_TEXT}")
def impute_mode(spark, folder):
    return prep.impute_mode(_labelled_lang(spark, folder).select("doc_id", "lang"), ["lang"])


@query("scale_pop", """
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6)
AS o_totalprice FROM orders""")
def scale_pop(spark, folder):
    return rounded(prep.scale_pop(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("ordinal_encode", """
SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand,
       (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type FROM part""")
def ordinal_encode(spark, folder):
    return prep.ordinal_encode(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query("ordinal_encode_large", """
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name FROM customer""")
def ordinal_encode_large(spark, folder):
    """As many values as rows: the dictionary is a table."""
    return prep.ordinal_encode(table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_name"])


@query("ordinal_encode_hot", """
SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY tag) - 1)::DOUBLE AS tag FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'hot' ELSE l_orderkey || '-' || l_linenumber END AS tag FROM lineitem)""")
def ordinal_encode_hot(spark, folder):
    """Half of all rows share a value, and the dictionary is too large to be sent along: it is joined, the hot rows apart."""
    lines = table(spark, folder, "lineitem")
    tag = F.when(F.col("l_quantity") > 25, "hot").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return prep.ordinal_encode(lines.select("l_orderkey", "l_linenumber", tag.alias("tag")), ["tag"], listed=10, broadcast=10)


@query("ordinal_encode_unseen", """
SELECT o.o_orderkey, coalesce(k.code, -1.0)::DOUBLE AS o_orderpriority FROM orders o LEFT JOIN (
  SELECT DISTINCT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '4') k ON o.o_orderpriority = k.o_orderpriority""")
def ordinal_encode_unseen(spark, folder):
    orders = table(spark, folder, "orders")
    known = orders.filter("o_orderstatus = 'F' and o_orderpriority < '4'")
    return prep.ordinal_encode(orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], known)


@query("prep_matrix", f"""
WITH filled AS (SELECT doc_id, n_chars::DOUBLE AS n_chars,
    coalesce(quality, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM {DOCS}))::DOUBLE AS quality, lang FROM {DOCS})
SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS n_chars,
       round((quality - avg(quality) OVER ()) / stddev_pop(quality) OVER (), 6) AS quality,
       (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS lang FROM filled""")
def prep_matrix(spark, folder):
    d = docs(spark, folder).select("doc_id", "n_chars", "quality", "lang")
    model = prep.TablePrep(numericCols=["n_chars", "quality"], categoricalCols=["lang"]).fit(d)
    return rounded(model.prepared_columns(d))


@query("label_encode", """
SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS code, event_type AS decoded FROM events""")
def label_encode(spark, folder):
    e = table(spark, folder, "events")
    codec = prep.LabelCodec.fit(e, "event_type")
    coded = e.select("event_id", codec.encode(F.col("event_type")).alias("code"))
    return coded.withColumn("decoded", codec.decode(F.col("code")))


@query("align_schema", "SELECT c_acctbal, NULL::VARCHAR AS c_phone, c_mktsegment, c_nationkey::DOUBLE AS c_nationkey FROM customer")
def align_schema(spark, folder):
    return prep.align(table(spark, folder, "customer"), ["c_acctbal", "c_phone", "c_mktsegment", "c_nationkey"],
                      ["double", "string", "string", "double"])


_O = sql_hash("42", "o_orderkey")


@query("holdout_split", f"SELECT o_orderkey, {_O} % 10000 < 2000 AS is_test FROM orders")
def holdout_split(spark, folder):
    return splits.holdout(table(spark, folder, "orders").select("o_orderkey"), key=["o_orderkey"])


@query("holdout_exact", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_O}, o_orderkey::VARCHAR) <= ceil(0.2 * (SELECT count(*) FROM orders)) AS is_test
FROM orders""")
def holdout_exact(spark, folder):
    return splits.holdout(table(spark, folder, "orders").select("o_orderkey"), key=["o_orderkey"], exact=True)


@query("three_way_split", f"""
SELECT o_orderkey, CASE WHEN {_O} % 10000 < 1000 THEN 'val' WHEN {_O} % 10000 < 2000 THEN 'test' ELSE 'train' END AS part
FROM orders""")
def three_way_split(spark, folder):
    return splits.three_way(table(spark, folder, "orders").select("o_orderkey"), key=["o_orderkey"])


@query("kfold", f"SELECT o_orderkey, ({sql_hash('fold42', 'o_orderkey')} % 5)::INT AS fold FROM orders")
def kfold(spark, folder):
    return splits.kfold(table(spark, folder, "orders").select("o_orderkey"), 5, key=["o_orderkey"])


@query("stratified_kfold", f"""
SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {sql_hash('fold42', 'o_orderkey')}, o_orderkey::VARCHAR) - 1) % 5)::INT AS fold FROM orders""")
def stratified_kfold(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_kfold(orders, 5, "o_orderstatus", key=["o_orderkey"])


@query("stratified_kfold_keys", f"""
WITH counts AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
keys AS (SELECT l_orderkey, arg_min(l_returnflag, (-n, l_returnflag)) AS c FROM counts GROUP BY 1),
folds AS (SELECT l_orderkey, ((row_number() OVER (PARTITION BY c ORDER BY {sql_hash('fold42', 'l_orderkey')}, l_orderkey::VARCHAR) - 1) % 5)::INT AS fold
          FROM keys)
SELECT l_orderkey, l_returnflag, fold, count(*) AS n FROM lineitem JOIN folds USING (l_orderkey) GROUP BY ALL""")
def stratified_kfold_keys(spark, folder):
    """The lines of an order share its fold."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    dealt = splits.stratified_kfold(lines, 5, "l_returnflag", key=["l_orderkey"])
    return dealt.groupBy("l_orderkey", "l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_kfold_copies", """
SELECT l_returnflag, f.fold::INT AS fold, (n // 4 + (f.fold < n % 4)::INT)::BIGINT AS n
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest(range(4)) AS fold) f""")
def stratified_kfold_copies(spark, folder):
    """Rows are copies of each other here (few distinct ones); classes are still dealt evenly."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    dealt = splits.stratified_kfold(lines, 4, "l_returnflag")
    return dealt.groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("prefix_sample", f"""
SELECT o_orderkey FROM orders WHERE {sql_hash('prefix42', 'o_orderkey')} % 10000 < 4000""")
def prefix_sample(spark, folder):
    return splits.prefix_sample(table(spark, folder, "orders").select("o_orderkey"), 0.4, key=["o_orderkey"])
