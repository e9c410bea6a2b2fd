"""Splits do not depend on partitioning and survive hot keys."""

import pytest
from pyspark.sql import functions as F

from tabspark.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                                                       (F.col("id") % 7 % 3 + 1).cast("int")).alias("label")).persist()


def _set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", [
    lambda d: splits.holdout(d, key=["id"]), lambda d: splits.holdout(d, key=["id"], exact=True),
    lambda d: splits.holdout(d), lambda d: splits.three_way(d, key=["id"]), lambda d: splits.kfold(d, 4, key=["id"]),
    lambda d: splits.stratified_kfold(d, 5, "label", key=["id"]), lambda d: splits.prefix_sample(d, 0.4, key=["id"])])
def test_same_at_any_partitioning(rows, split):
    expected = _set(split(rows.coalesce(1)))
    assert _set(split(rows.repartition(4))) == expected == _set(split(rows.repartition(7, "label")))


def test_sizes(rows):
    assert splits.holdout(rows, key=["id"], exact=True).filter("is_test").count() == 800
    parts = {r.part: r["count"] for r in splits.three_way(rows, key=["id"]).groupBy("part").count().collect()}
    assert sum(parts.values()) == 4000 and abs(parts["train"] - 3200) < 150 and abs(parts["val"] - parts["test"]) < 150


def test_prefixes_are_nested(rows):
    kept = [{r.id for r in splits.prefix_sample(rows, s, key=["id"]).collect()} for s in (0.2, 0.6, 1.0)]
    assert kept[0] < kept[1] < kept[2] and len(kept[2]) == 4000


def test_equal_rows_stay_together(spark):
    df = spark.createDataFrame([(i % 50, "x") for i in range(500)], "a int, b string")
    assert splits.holdout(df).distinct().count() == 50


def test_stratified_with_a_third_of_copies(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
                                  (F.col("id") % 2).alias("label"))
    counts = splits.stratified_kfold(df, 5, "label").groupBy("label", "fold").count().collect()
    assert len(counts) == 10 and all(r["count"] == 600 for r in counts)
    first = splits.stratified_kfold(df, 5, "label").groupBy("k", "label", "fold").count()
    second = splits.stratified_kfold(df.repartition(9), 5, "label").groupBy("k", "label", "fold").count()
    assert _set(first) == _set(second)        # copies are interchangeable


@pytest.mark.parametrize("split", [
    lambda d: splits.stratified_kfold(d, 5, "label", key=["k"]), lambda d: splits.holdout(d, key=["k"], exact=True)])
def test_repeated_keys_stay_together(spark, split):
    df = spark.range(3000).select((F.col("id") % 50).alias("k"), "id", (F.col("id") % 3).alias("label"))
    side = "fold" if "fold" in split(df).columns else "is_test"
    assert split(df).select("k", side).distinct().count() == 50
    assert _set(split(df.coalesce(1))) == _set(split(df.repartition(4))) == _set(split(df.repartition(7, "label")))


def test_ranks_are_complete(rows):
    ranked = splits.hash_rank(rows, ["label"], "s", ["id"])
    got = ranked.groupBy("label").agg(F.countDistinct("_rank").alias("d"), F.max("_rank").alias("m"), F.count("*").alias("n"))
    assert all(r.d == r.n == r.m + 1 for r in got.collect())


def test_fold_bounds(rows):
    with pytest.raises(ValueError):
        splits.kfold(rows, 1)
    assert splits.kfold(rows, 20).select("fold").distinct().count() == 20
