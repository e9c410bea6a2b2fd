"""Queries: profiling."""

from pyspark.sql import functions as F

from tabspark.catalog.base import DOCS, EVENTS, docs, events, query, rounded, sql_hash, table
from tabspark.operators import counting, profile
from tabspark.operators.quantiles import quantiles

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dataset_summary", f"""
SELECT count(*) AS rows, 6::BIGINT AS columns,
       (sum((quality IS NULL)::INT) + sum((toxic IS NULL)::INT))::BIGINT AS missing,
       round_even(((sum((quality IS NULL)::INT) + sum((toxic IS NULL)::INT)) / (count(*) * 6) * 100) * 100, 0) / 100 AS missing_pct,
       4::BIGINT AS numeric_columns, 2::BIGINT AS other_columns
FROM {DOCS}""")
def dataset_summary(spark, folder):
    return profile.summary(docs(spark, folder))


@query("dataset_delta", f"""
SELECT -(count(*) - count(quality))::BIGINT AS delta_rows, -1::BIGINT AS delta_columns FROM {DOCS}""")
def dataset_delta(spark, folder):
    raw = docs(spark, folder)
    return profile.delta(raw, raw.filter("quality is not null").drop("source"))


def _quality_sql(source: str, columns: dict[str, str], k: float = 1.5) -> str:
    """``columns``: name -> type; numeric types get outlier counts."""
    parts = []
    for c, kind in columns.items():
        if kind in ("string", "timestamp"):
            out, pct = "NULL::BIGINT", "NULL::DOUBLE"
            frame = f"SELECT {c} AS v FROM {source}"
            body = "SELECT count(*) AS n, count(*) - count(v) AS m, NULL::BIGINT AS o FROM t"
        else:
            frame = f"SELECT {c}::DOUBLE AS v FROM {source}"
            body = (f"SELECT count(*) AS n, count(*) - count(v) AS m, "
                    f"count(*) FILTER (v < q1 - {k} * (q3 - q1) OR v > q3 + {k} * (q3 - q1)) AS o "
                    f"FROM t, (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t)")
            out, pct = "o::BIGINT", "round_even((o / n * 100) * 10, 0) / 10"
        parts.append(f"SELECT * FROM (WITH t AS ({frame}) SELECT '{c}' AS \"column\", '{kind}' AS dtype, "
                     f"m::BIGINT AS missing, round_even((m / n * 100) * 10, 0) / 10 AS missing_pct, {out} AS outliers, "
                     f"{pct} AS outlier_pct FROM ({body}))")
    return " UNION ALL ".join(parts)


@query("quality_report", _quality_sql(EVENTS, {"event_id": "bigint", "user_id": "bigint", "event_type": "string",
                                               "value": "double"}))
def quality_report(spark, folder):
    return profile.quality_report(events(spark, folder))


@query("quality_report_lineitem", _quality_sql("lineitem", {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}))
def quality_report_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem")
    return profile.quality_report(lines.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")))


def _outliers_sql(source: str, columns: list[str], k: float) -> str:
    full = _quality_sql(source, {c: "double" for c in columns}, k)
    return f'SELECT "column", outliers FROM ({full}) WHERE outliers > 0'


@query("outlier_counts", _outliers_sql(EVENTS, ["event_id", "user_id", "value"], 2.0))
def outlier_counts(spark, folder):
    return profile.outlier_counts(events(spark, folder), 2.0)


@query("outlier_counts_documents", _outliers_sql(DOCS, ["doc_id", "n_chars", "quality", "toxic"], 1.5))
def outlier_counts_documents(spark, folder):
    return profile.outlier_counts(docs(spark, folder))


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (count(*) - count({c}))::BIGINT AS missing, "
    f"round_even(((count(*) - count({c})) / count(*) * 100) * 10, 0) / 10 AS missing_pct FROM {DOCS}"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic"))


@query("missing_counts", f"SELECT * FROM ({_MISSING}) WHERE missing > 0")
def missing_counts(spark, folder):
    return profile.missing_counts(docs(spark, folder))


@query("columns_over_missing", f"SELECT * FROM ({_MISSING}) WHERE missing_pct > 50")
def columns_over_missing(spark, folder):
    return profile.columns_over_missing(docs(spark, folder), 50)


@query("describe_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round_even((avg({c})) * 100, 0) / 100 AS mean, "
    f"round_even((stddev_samp({c})) * 100, 0) / 100 AS std, round_even((min({c})::DOUBLE) * 100, 0) / 100 AS min, "
    f"round_even((quantile_cont({c}::DOUBLE, 0.25)) * 100, 0) / 100 AS q25, round_even((quantile_cont({c}::DOUBLE, 0.5)) * 100, 0) / 100 AS median, "
    f"round_even((quantile_cont({c}::DOUBLE, 0.75)) * 100, 0) / 100 AS q75, round_even((max({c})::DOUBLE) * 100, 0) / 100 AS max FROM {EVENTS}"
    for c in ("event_id", "user_id", "value")))
def describe_numeric(spark, folder):
    return profile.describe(events(spark, folder))


def _corr_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(regr_sxy({b}, {a}) / sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})), 6) "
        f"AS corr FROM {source}" for a in columns for b in columns)


@query("corr_matrix", _corr_sql("lineitem", LINE))
def corr_matrix(spark, folder):
    return rounded(profile.corr_matrix(table(spark, folder, "lineitem"), LINE))


@query("corr_matrix_missing", _corr_sql(DOCS, ["n_chars", "quality", "toxic"]))
def corr_matrix_missing(spark, folder):
    return rounded(profile.corr_matrix(docs(spark, folder), ["n_chars", "quality", "toxic"]))


@query("corr_matrix_wide", """
WITH long AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)
SELECT 'e' || p.i AS a, 'e' || q.i AS b, round(corr(p.v, q.v), 6) AS corr
FROM long p JOIN long q ON p.vec_id = q.vec_id GROUP BY p.i, q.i""")
def corr_matrix_wide(spark, folder):
    vectors = table(spark, folder, "embeddings")
    spread = vectors.select([F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return rounded(profile.corr_matrix(spread))


_BIN = "least(floor((value - lo) / ((hi - lo) / 30.0)), 29)::BIGINT"
_LIMITS = f"(SELECT min(value) AS lo, max(value) AS hi FROM {EVENTS})"


@query("histogram", f"""
SELECT bin, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high, n FROM (
  SELECT {_BIN} AS bin, lo, (hi - lo) / 30.0 AS w, count(*) AS n FROM {EVENTS}, {_LIMITS}
  WHERE value IS NOT NULL GROUP BY ALL)""")
def histogram(spark, folder):
    return rounded(profile.histogram(events(spark, folder), "value", 30))


@query("histogram_by", f"""
SELECT event_type, bin, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high, n FROM (
  SELECT event_type, {_BIN} AS bin, lo, (hi - lo) / 30.0 AS w, count(*) AS n FROM {EVENTS}, {_LIMITS}
  WHERE value IS NOT NULL GROUP BY ALL)""")
def histogram_by(spark, folder):
    return rounded(profile.histogram(events(spark, folder), "value", 30, "event_type"))


def _box_sql(by: str) -> str:
    keep = f"{by}, " if by else ""
    return f"""
WITH q AS (SELECT {keep}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM {EVENTS} WHERE value IS NOT NULL GROUP BY ALL)
SELECT {('e.' + by + ', ') if by else ''}count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {EVENTS} e JOIN q ON {f'e.{by} = q.{by}' if by else 'true'} WHERE value IS NOT NULL
GROUP BY {('e.' + by + ', ') if by else ''}q1, median, q3"""


@query("box_stats", _box_sql(""))
def box_stats(spark, folder):
    return rounded(profile.box_stats(events(spark, folder), "value"), 6, "q1", "median", "q3")


@query("box_stats_by_user", """
WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY user_id)
SELECT user_id, count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM events JOIN q USING (user_id) GROUP BY user_id, q1, median, q3""")
def box_stats_by_user(spark, folder):
    """Far more than a hundred groups."""
    return rounded(profile.box_stats(table(spark, folder, "events"), "value", "user_id"), 6, "q1", "median", "q3")


@query("box_stats_by", _box_sql("event_type"))
def box_stats_by(spark, folder):
    return rounded(profile.box_stats(events(spark, folder), "value", "event_type"), 6, "q1", "median", "q3")


@query("scatter_sample", f"""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
ORDER BY {sql_hash('scatter42', 'o_orderkey')}, o_orderkey LIMIT 1000""")
def scatter_sample(spark, folder):
    orders = table(spark, folder, "orders")
    return profile.scatter_points(orders, "o_custkey", "o_totalprice", "o_orderstatus", 1000, ["o_orderkey"])


@query("scatter_grid", """
SELECT least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19)::BIGINT AS x_bin,
       least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19)::BIGINT AS y_bin, count(*) AS n
FROM lineitem, (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                       max(l_extendedprice) AS y1 FROM lineitem) GROUP BY ALL""")
def scatter_grid(spark, folder):
    return profile.scatter_grid(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 20)


@query("input_domains", f"""
SELECT DISTINCT 'lang' AS feature, 'choice' AS kind, lang AS choice, NULL::DOUBLE AS "default" FROM {DOCS} WHERE lang IS NOT NULL
UNION ALL SELECT DISTINCT 'quality', 'choice', quality::VARCHAR, NULL FROM {DOCS} WHERE quality IS NOT NULL
UNION ALL SELECT 'n_chars', 'number', NULL, trunc(quantile_cont(n_chars::DOUBLE, 0.5)) FROM {DOCS}
UNION ALL SELECT DISTINCT 'source', 'choice', source, NULL FROM {DOCS} WHERE source IS NOT NULL""")
def input_domains(spark, folder):
    return profile.input_domains(docs(spark, folder), ["lang", "quality", "n_chars", "source"])


@query("value_counts", """
SELECT event_type AS value, count(*) AS n, round_even((count(*) / (SELECT count(*) FROM events) * 100) * 10, 0) / 10 AS pct
FROM events GROUP BY event_type""")
def value_counts(spark, folder):
    return counting.value_counts(table(spark, folder, "events"), "event_type")


@query("quantiles_bracketed", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value FROM lineitem"
    for c in (*LINE, "l_partkey") for p in (0.01, 0.25, 0.5, 0.75, 0.99)))
def quantiles_bracketed(spark, folder):
    """The large-table path of the quantiles, forced."""
    probs, cols = (0.01, 0.25, 0.5, 0.75, 0.99), [*LINE, "l_partkey"]
    found = quantiles(table(spark, folder, "lineitem"), cols, probs, small_cells=0)
    rows = [(c, p, v) for c in cols for p, v in zip(probs, found[c])]
    return rounded(spark.createDataFrame(rows, "column string, p double, value double"))


@query("detect_task", """
SELECT 'l_linenumber' AS target, CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem
UNION ALL SELECT 'l_partkey', CASE WHEN count(DISTINCT l_partkey) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem
UNION ALL SELECT 'l_discount', 'regression'
UNION ALL SELECT 'l_returnflag', CASE WHEN count(DISTINCT l_returnflag) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem""")
def detect_task(spark, folder):
    lines = table(spark, folder, "lineitem")
    rows = [(t, profile.detect_task(lines, t)) for t in ("l_linenumber", "l_partkey", "l_discount", "l_returnflag")]
    return spark.createDataFrame(rows, "target string, task string")
