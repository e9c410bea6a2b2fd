"""Queries: metrics, verdicts and comparisons on predictions by fixed rules."""

from pyspark.sql import functions as F

from tabspark.catalog.base import query, rounded, table
from tabspark.operators import metrics, models

# a rule that never says 'P' and says 'X', which is no true status
_RULE = "CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 400000 THEN 'O' ELSE 'X' END"
_PRED = f"(SELECT o_orderstatus AS label, {_RULE} AS prediction FROM orders)"


def _status(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderstatus").alias("label"), F.expr(_RULE).alias("prediction"))


@query("accuracy_macro", f"""
WITH p AS {_PRED}, l AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
k AS (SELECT c, count(*) FILTER (label = c) AS t, count(*) FILTER (prediction = c) AS q,
             count(*) FILTER (label = c AND prediction = c) AS h FROM p, l GROUP BY c)
SELECT round_even((sum(h) / sum(t)) * 1000, 0) / 1000 AS accuracy, round_even((avg(CASE WHEN q > 0 THEN h / q ELSE 0 END)) * 1000, 0) / 1000 AS "precision",
       round_even((avg(CASE WHEN t > 0 THEN h / t ELSE 0 END)) * 1000, 0) / 1000 AS recall FROM k""")
def accuracy_macro(spark, folder):
    return metrics.classification_metrics(_status(spark, folder))


@query("accuracy_macro_binary", """
WITH p AS (SELECT quality AS label, (n_chars > 1000)::INT AS prediction FROM documents JOIN labels USING (doc_id)),
l AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
k AS (SELECT c, count(*) FILTER (label = c) AS t, count(*) FILTER (prediction = c) AS q,
             count(*) FILTER (label = c AND prediction = c) AS h FROM p, l GROUP BY c)
SELECT round_even((sum(h) / sum(t)) * 1000, 0) / 1000 AS accuracy, round_even((avg(CASE WHEN q > 0 THEN h / q ELSE 0 END)) * 1000, 0) / 1000 AS "precision",
       round_even((avg(CASE WHEN t > 0 THEN h / t ELSE 0 END)) * 1000, 0) / 1000 AS recall FROM k""")
def accuracy_macro_binary(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    return metrics.classification_metrics(
        d.select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction")))


_GRID = "(SELECT unnest(['F', 'O', 'P', 'X']) AS actual), (SELECT unnest(['F', 'O', 'P', 'X']) AS predicted)"


@query("confusion", f"""
SELECT actual, predicted, (SELECT count(*) FROM {_PRED} WHERE label = actual AND prediction = predicted) AS n FROM {_GRID}""")
def confusion(spark, folder):
    return metrics.confusion(_status(spark, folder), ["F", "O", "P", "X"])


@query("confusion_pct", f"""
SELECT actual, predicted, n, CASE WHEN total > 0 THEN round_even((n / total * 100) * 10, 0) / 10 ELSE 0.0::DOUBLE END AS pct FROM (
  SELECT actual, predicted, (SELECT count(*) FROM {_PRED} WHERE label = actual AND prediction = predicted) AS n,
         (SELECT count(*) FROM {_PRED} WHERE label = actual) AS total FROM {_GRID})""")
def confusion_pct(spark, folder):
    return metrics.confusion(_status(spark, folder), ["F", "O", "P", "X"], normalize=True)


def _price_sql(predicted: str) -> str:
    return f"""SELECT round_even((1 - avg((y - p) ** 2) / var_pop(y)) * 1000, 0) / 1000 AS r2, round_even((avg(abs(y - p))) * 1000, 0) / 1000 AS mae,
       round_even((sqrt(avg((y - p) ** 2))) * 1000, 0) / 1000 AS rmse
FROM (SELECT l_extendedprice AS y, {predicted} AS p FROM lineitem)"""


def _price(spark, folder, predicted: str):
    return table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                                   F.expr(predicted).alias("prediction"))


@query("regression_metrics", _price_sql("l_quantity * 2000"))
def regression_metrics(spark, folder):
    return metrics.regression_metrics(_price(spark, folder, "l_quantity * 2000"))


@query("regression_metrics_constant", """
SELECT CASE WHEN max(abs(p)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r2, round_even(avg(abs(p)) * 1000, 0) / 1000 AS mae,
       round_even(sqrt(avg(p * p)) * 1000, 0) / 1000 AS rmse FROM (SELECT l_quantity * l_discount AS p FROM lineitem)""")
def regression_metrics_constant(spark, folder):
    """A target that is nought throughout, against what the lines' discounts come to."""
    lines = table(spark, folder, "lineitem").select((F.col("l_quantity") * F.col("l_discount")).alias("prediction"))
    return metrics.regression_metrics(lines.withColumn("label", F.lit(0.0)))


def _metrics_of(rule: str) -> str:
    return f"SELECT metric, value FROM (UNPIVOT ({_price_sql(rule)}) ON r2, mae, rmse INTO NAME metric VALUE value)"


@query("compare_runs", f"""
SELECT a.metric, a.value AS a, b.value AS b, round(a.value - b.value, 6) AS delta,
       CASE WHEN abs(a.value - b.value) < 0.005 THEN 'tie'
            WHEN (a.metric = 'r2' AND a.value > b.value) OR (a.metric <> 'r2' AND a.value < b.value) THEN 'a' ELSE 'b' END AS winner
FROM ({_metrics_of("52000 + l_quantity * 2")}) a JOIN ({_metrics_of("52000 + l_tax * 0")}) b ON a.metric = b.metric""")
def compare_runs(spark, folder):
    a = metrics.metrics_long(metrics.regression_metrics(_price(spark, folder, "52000 + l_quantity * 2")))
    b = metrics.metrics_long(metrics.regression_metrics(_price(spark, folder, "52000 + l_tax * 0")))
    return rounded(metrics.compare_runs(a, b))


# Curves and histories that the tables give: averages per group and line number.

_CURVE = """(SELECT l_returnflag, l_linestatus, l_linenumber AS train_size, 1 - avg(l_discount) AS train_mean,
                    1 - avg(l_discount) - 3 * avg(l_tax) * (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0.3 END) AS val_mean,
                    'accuracy' AS scoring FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)"""


def _curve(spark, folder):
    factor = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(0.3)
    return (table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("train_size"))
            .agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
            .select("l_returnflag", "l_linestatus", "train_size", (1 - F.col("d")).alias("train_mean"),
                    (1 - F.col("d") - 3 * F.col("t") * factor).alias("val_mean"), F.lit("accuracy").alias("scoring")))


@query("lc_verdict", f"""
SELECT l_returnflag, l_linestatus, round_even((train - val) * 1000, 0) / 1000 AS gap, round_even((val) * 1000, 0) / 1000 AS val,
       CASE WHEN round_even((train - val) * 1000, 0) / 1000 > 0.15 THEN 'overfit' WHEN scoring = 'accuracy' AND round_even((val) * 1000, 0) / 1000 < 0.6 THEN 'underfit'
            WHEN round_even((train - val) * 1000, 0) / 1000 <= 0.05 THEN 'good' ELSE 'moderate' END AS verdict
FROM (SELECT l_returnflag, l_linestatus, max_by(train_mean, train_size) AS train, max_by(val_mean, train_size) AS val,
             max(scoring) AS scoring FROM {_CURVE} GROUP BY 1, 2)""")
def lc_verdict(spark, folder):
    return metrics.diagnose_learning_curve(_curve(spark, folder), ["l_returnflag", "l_linestatus"])


_HISTORY = """(SELECT l_returnflag, l_linenumber AS epoch, round(avg(l_tax) * 20, 5) AS train_loss,
                      round(avg(l_discount) * (CASE l_returnflag WHEN 'A' THEN 16 ELSE 30 END), 5) AS val_loss
               FROM lineitem GROUP BY l_returnflag, l_linenumber)"""


def _history(spark, folder):
    factor = F.when(F.col("l_returnflag") == "A", 16).otherwise(30)
    return (table(spark, folder, "lineitem")
            .groupBy("l_returnflag", F.col("l_linenumber").alias("epoch"))
            .agg(F.round(F.avg("l_tax") * 20, 5).alias("train_loss"), F.avg("l_discount").alias("d"))
            .select("l_returnflag", "epoch", "train_loss", F.round(F.col("d") * factor, 5).alias("val_loss")))


@query("loss_verdict", f"""
SELECT l_returnflag, epochs, gap, CASE WHEN epochs < 7 THEN 'early_stopped' WHEN gap > 0.3 THEN 'overfit'
       WHEN train > 0.5 AND val > 0.5 THEN 'underfit' ELSE 'ok' END AS verdict
FROM (SELECT l_returnflag, max(epoch) AS epochs, max_by(train_loss, epoch) AS train, max_by(val_loss, epoch) AS val,
             round_even(abs(max_by(train_loss, epoch) - max_by(val_loss, epoch)) * 10000, 0) / 10000 AS gap FROM {_HISTORY} GROUP BY 1)""")
def loss_verdict(spark, folder):
    return metrics.diagnose_loss(_history(spark, folder), 7, ["l_returnflag"])


@query("best_epoch", f"""
SELECT l_returnflag, epoch AS best_epoch, val_loss AS best_val_loss FROM {_HISTORY}
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY val_loss, epoch) = 1""")
def best_epoch(spark, folder):
    return metrics.best_epoch(_history(spark, folder), ["l_returnflag"])




@query("vote_soft", f"""
SELECT l_orderkey, l_linenumber, round(p0, 6) AS p0, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS prediction FROM (
  SELECT l_orderkey, l_linenumber, ((d + t) + q) / 3 AS p0, (((1 - d) + (1 - t)) + (1 - q)) / 3 AS p1
  FROM (SELECT l_orderkey, l_linenumber, l_discount * 10::DOUBLE AS d, l_tax * 12.5::DOUBLE AS t, l_quantity / 50 AS q FROM lineitem))""")
def vote_soft(spark, folder):
    lines = table(spark, folder, "lineitem")
    firsts = [F.col("l_discount") * 10.0, F.col("l_tax") * 12.5, F.col("l_quantity") / 50]
    voted = lines.withColumn("p", models.vote([F.array(p, 1 - p) for p in firsts], 2))
    return voted.select("l_orderkey", "l_linenumber", F.round(F.col("p")[0], 6).alias("p0"),
                        models.argmax(F.col("p")).alias("prediction"))


@query("vote_mean", """
SELECT l_orderkey, l_linenumber, round(((l_quantity * 2000 + l_extendedprice) + l_tax * 1000) / 3, 4) AS prediction FROM lineitem""")
def vote_mean(spark, folder):
    members = [F.col("l_quantity") * 2000, F.col("l_extendedprice"), F.col("l_tax") * 1000]
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber",
                                                   F.round(models.vote(members, None), 4).alias("prediction"))
