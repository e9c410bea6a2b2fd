"""Hand-computed tables: missing values, ties, bounds, typing and formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabspark as ts
from tabspark.functions.formula import formula_column
from tabspark.operators import clean, counting, prep, profile, quantiles as Q
from tabspark.sources.tables import same_rows

X = [(1.0,), (None,), (4.0,), (10.0,), (100.0,)]


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame(X, "x double")


def test_quantiles_interpolate(x):
    assert Q.quantiles(x, ["x"], (0.25, 0.5, 0.75))["x"] == [3.25, 7.0, 32.5]
    assert Q.quantiles(x, ["x"], (0.25, 0.5, 0.75), small_cells=0)["x"] == [3.25, 7.0, 32.5]


PROBS = (0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_large_quantiles_equal_small_ones(spark, monkeypatch, parts):
    """A third of the rows share one value, the rest is heavy-tailed; NaN, NULL, constants."""
    monkeypatch.setattr(Q, "SMALL_BRACKET", 5)
    df = (spark.range(0, 20_000, 1, parts)
          .select(F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 50)).alias("a"),
                  F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("b"),
                  F.lit(None).cast("double").alias("c"), F.lit(3).alias("d"),
                  F.when(F.col("id") < 2, F.col("id")).alias("e")))
    small = Q.quantiles(df, df.columns, PROBS, small_cells=10 ** 9)
    large = Q.quantiles(df, df.columns, PROBS, small_cells=0)
    for c in df.columns:
        assert large[c] == pytest.approx(small[c], rel=1e-12) if small[c][0] is not None else large[c] == small[c]


def test_clip_keeps_missing(x):
    got = [r.x for r in ts.clip_outliers(x, k=1.0).collect()]
    assert got == [1.0, None, 4.0, 10.0, 61.75]


def test_quality_report(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else None) for i in range(20)] + [(1000.0, "b")], "v double, s string")
    rows = {r["column"]: r for r in ts.quality_report(df).collect()}
    assert (rows["v"].outliers, rows["v"].outlier_pct, rows["v"].missing) == (1, 4.8, 0)
    assert (rows["s"].outliers, rows["s"].missing, rows["s"].missing_pct) == (None, 10, 47.6)


def test_missing_threshold_uses_rounded_share_strictly(spark):
    df = spark.createDataFrame([(None if i < 500 else 1,) for i in range(1000)], "a int")
    assert ts.columns_over_missing(df, 50).count() == 0
    df = spark.createDataFrame([(None if i < 501 else 1,) for i in range(1000)], "a int")
    assert [r["column"] for r in ts.columns_over_missing(df, 50).collect()] == ["a"]
    df = spark.createDataFrame([(None if i < 50_01 else 1,) for i in range(100_00)], "a int")
    assert ts.columns_over_missing(df, 50).count() == 0        # 50.01 % rounds to 50.0


def test_rounding_is_numpys(spark):
    from tabspark.functions.columns import half_even
    values = [73.475, 0.575, 12.25, 0.35, 2.675, 1.005, -0.125, 36.625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        got = [r.r for r in df.select(half_even(F.col("v"), digits).alias("r")).collect()]
        assert got == list(np.round(values, digits))


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "a double")
    assert ts.missing_counts(df).first()["missing"] == 2
    assert ts.fill_missing(df, {"a": "mean"}).filter("a = 1").count() == 3


def test_mode_ties_and_types(spark):
    df = spark.createDataFrame([("b", 2, True), ("a", 1, False), ("b", 1, None), ("a", 2, True), (None, None, None)],
                               "s string, i int, b boolean")
    assert counting.modes(df, ["s", "i", "b"]) == {"s": "a", "i": 1, "b": True}


def test_fill_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "i int, s string")
    got = ts.fill_missing(df, {"i": "median", "s": "constant"})
    assert [tuple(r) for r in got.collect()] == [(1.0, "a"), (2.0, "unknown"), (1.5, "unknown")]
    assert dict(ts.fill_missing(df, {"i": "constant"}).dtypes)["i"] == "int"
    with pytest.raises(ValueError):
        ts.fill_missing(df, {"s": "mean"})
    with pytest.raises(ValueError):
        ts.fill_missing(df, {"i": "constant"}, {"i": "x"})


def test_correlation_with_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 6.5)], "a int, b int, c double")
    got = {(r.a, r.b): r.corr for r in ts.corr_matrix(df).collect()}
    assert got["a", "b"] is None and got["b", "b"] == pytest.approx(1.0)
    assert got["b", "c"] == got["c", "b"] == pytest.approx(0.9979, abs=1e-4)


def test_wide_correlation_equals_pairwise(spark, monkeypatch):
    df = spark.range(500).select(*[F.when(F.col("id") % (11 + i) > 0, F.sin(F.col("id") * (i + 1)) + 1e6 * i)
                                   .alias(f"c{i}") for i in range(6)], F.lit(2.0).alias("k"))
    narrow = {(r.a, r.b): r.corr for r in ts.corr_matrix(df).collect()}
    monkeypatch.setattr(profile, "PAIR_LIMIT", 2)
    from tabspark.operators import gram
    monkeypatch.setattr(gram, "TILE", 2)          # several tiles, in several passes
    monkeypatch.setattr(gram, "TILES", 2)
    wide = {(r.a, r.b): r.corr for r in ts.corr_matrix(df).collect()}
    assert wide.keys() == narrow.keys()
    for k in narrow:
        assert wide[k] == (None if narrow[k] is None else pytest.approx(narrow[k], abs=1e-9))


def test_histogram_puts_maximum_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    got = {r.bin: r.n for r in ts.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    constant = ts.histogram(df.select(F.lit(3.0).alias("v")), "v", 5).collect()
    assert [(r.bin, r.n) for r in constant] == [(0, 11)]


def test_input_domains(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), (F.col("id") / 8).alias("real"),
                                (F.col("id") % 2 == 0).alias("flag"), F.concat(F.lit("u"), "id").alias("names"))
    rows = ts.input_domains(df, df.columns).collect()
    got = {r.feature: r for r in rows}
    listed = lambda name: sorted(r.choice for r in rows if r.feature == name)
    assert listed("few") == ["0", "1", "2"] and listed("flag") == ["false", "true"]
    assert got["many"].default == 19.0 and got["real"].default == 2.4375
    assert got["names"].kind == "choice" and listed("names") == sorted(f"u{i}" for i in range(40))


def test_box_stats_of_many_groups(spark):
    df = spark.range(3000).select((F.col("id") % 250).alias("g"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = {r.g: r for r in ts.box_stats(df, "v", "g").collect()}
    assert len(got) == 250
    for g in (0, 17, 249):
        want = np.quantile([i * 7919 % 1009 for i in range(g, 3000, 250)], [0.25, 0.5, 0.75])
        assert [got[g].q1, got[g].median, got[g].q3] == pytest.approx(list(want))


def test_infinities_are_counted_beside_the_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (*range(11), math.inf, math.inf, -math.inf)], "v double")
    assert {r.bin: r.n for r in ts.histogram(df, "v", 5).collect()} == {-1: 1, 0: 2, 1: 2, 2: 2, 3: 2, 4: 3, 5: 2}


def test_tables_without_numbers(spark):
    words = spark.createDataFrame([("a",)], "w string")
    assert ts.describe(words).count() == 0 and ts.corr_matrix(words).count() == 0


def test_formulas_over_odd_names_and_values(spark):
    df = spark.createDataFrame([(2, 3, math.nan)], "`my col` int, b int, n double")
    value = lambda f: df.select(formula_column(df, f).alias("r")).first()["r"]
    assert value("`my col` + b * 2") == 8 and value("+b ** `my col`") == 9 and value("n / 0") is None
    assert value("3 ** 39") == 3 ** 39 and value("(-1) ** 1001") == -1
    for bad in ("b ** -1", "9 ** 30"):
        with pytest.raises(Exception):
            value(bad)


def test_classify_columns(spark):
    df = spark.createDataFrame([], "a int, b decimal(10,2), c string, d boolean, e timestamp, f array<int>")
    kinds = profile.classify_columns(df.schema)
    assert kinds == profile.classify_columns(df.schema).__class__(("a", "b"), ("c", "d"), ("e", "f"))


@pytest.mark.parametrize("formula, expected", [
    ("a + b * 2", 7.0), ("(a + b) * 2", 8.0), ("-a ** 2", -1.0), ("b / 0", math.inf), ("-b / 0", -math.inf),
    ("(a - 1) / 0", None), ("a ** 3", 1), ("b ** 0.5", math.sqrt(3)), ("i / 2", 3.5), ("i * 2", 14)])
def test_formula(spark, formula, expected):
    df = spark.createDataFrame([(1.0, 3.0, 7)], "a double, b double, i int")
    got = df.select(formula_column(df, formula).alias("r")).first()["r"]
    assert got == (expected if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("formula", ["__import__('os')", "a.b", "a if b else a", "s + 1", "missing + 1", "a; b", "a < b", "'x'"])
def test_formula_refuses_code(spark, formula):
    df = spark.createDataFrame([(1.0, 3.0, "t")], "a double, b double, s string")
    with pytest.raises((ValueError, SyntaxError)):
        formula_column(df, formula)


def test_passenger_formula(spark):
    df = spark.createDataFrame([(1, 2, 7.25), (0, 0, 8.0)], "SibSp bigint, Parch bigint, Fare double")
    assert [r.f for r in ts.derive(df, "f", "(SibSp + Parch) * Fare").collect()] == [21.75, 0.0]
    assert ts.derive(df, "Fare", "Fare * 2").columns == df.columns


CSV = 'id,num,mixed,flag,text,empty\n1,NA,1,True,"a, ""b""",\n2,1.5,x,False,"line\none",\n3,nan,N/A,,null,NA\n'


def test_csv_tokens_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = ts.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "num": "double", "mixed": "string", "flag": "boolean", "text": "string",
                               "empty": "double"}
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, None, "1", True, 'a, "b"', None), (2, 1.5, "x", False, "line\none", None),
                    (3, None, None, None, None, None)]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = ts.read_csv(spark, str(tmp_path / "t.csv"))
    ts.write_csv(df, str(tmp_path / "out"))
    assert same_rows(df, ts.read_csv(spark, str(tmp_path / "out")))


def test_parquet_reads_nan_as_missing(spark, tmp_path):
    ts.write_parquet(spark.createDataFrame([(float("nan"),), (2.0,)], "a double"), str(tmp_path / "p"))
    assert ts.read_parquet(spark, str(tmp_path / "p")).filter("a is null").count() == 1


def test_scale_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5), (4.0, 5), (10.0, 5), (100.0, 5)], "x double, k int")
    got = prep.scale_pop(df, ["x", "k"]).collect()
    assert got[0].x == pytest.approx((1 - 28.75) / 41.2636, abs=1e-4) and {r.k for r in got} == {0.0}


def test_codes_sorted_unseen_and_missing(spark):
    seen = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert [r.c for r in prep.ordinal_encode(new, ["c"], seen).collect()] == [0.0, 1.0, -1.0, -1.0]


@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_large_dictionary(spark, monkeypatch, broadcast):
    """Dictionary as a table, looked up by broadcast or by shuffle with hot values apart."""
    monkeypatch.setattr(prep, "LISTED_VALUES", 3)
    monkeypatch.setattr(prep, "BROADCAST_VALUES", broadcast)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("v"), F.lpad((F.col("id") % 500).cast("string"), 3, "0"))).alias("c"))
    names = sorted({r.c for r in df.select("c").distinct().collect()})
    got = prep.ordinal_encode(df, ["c"]).join(df.withColumnRenamed("c", "t"), "id").collect()
    assert len(got) == 3000 and all(r.c == names.index(r.t) for r in got)
    other = spark.createDataFrame([("hot",), ("none",), (None,)], "c string")
    coded = [r.c for r in prep.ordinal_encode(other, ["c"], df).collect()]
    assert sorted(coded) == [-1.0, -1.0, float(names.index("hot"))]


def test_prep_model_fills_scales_and_codes(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (8.0, "a")], "x double, c string")
    model = prep.TablePrep(numericCols=["x"], categoricalCols=["c"]).fit(train)
    rows = model.prepared_columns(spark.createDataFrame([(None, None), (3.0, "q")], "x double, c string")).collect()
    mean, std = (1 + 3 + 3 + 8) / 4, math.sqrt(sum((v - 3.75) ** 2 for v in (1, 3, 3, 8)) / 4)
    assert rows[0].x == pytest.approx((3 - mean) / std) and rows[0].c == 0.0 and rows[1].c == -1.0
    assert len(model.transform(train).first().features) == 2


def test_align(spark):
    df = spark.createDataFrame([("7", 2, 3)], "a string, extra int, b int")
    got = prep.align(df, ["b", "a", "gone"], ["int", "double", "string"])
    assert got.columns == ["b", "a", "gone"] and tuple(got.first()) == (3, 7.0, None)


def test_recipe(spark):
    raw = spark.createDataFrame([(1.0, None, "a"), (2.0, None, None), (300.0, 1.0, "a"), (None, None, "b")] * 5,
                                "x double, sparse double, s string")
    steps = (ts.Recipe().drop_sparse_columns(50).clip_outliers().fill_missing({"x": "median", "s": "mode"})
             .derive("x2", "x * 2"))
    again = ts.Recipe.from_json(steps.to_json())
    assert same_rows(steps.apply(raw), again.apply(raw))
    frozen = ts.Recipe.from_json(steps.fit(raw).to_json())
    assert same_rows(frozen.apply(raw), steps.apply(raw))
    other = spark.createDataFrame([(None, None, None)], "x double, sparse double, s string")
    assert tuple(frozen.apply(other).first()) == (2.0, "a", 4.0)       # the learned values, on new data
    assert steps.derived() == ["x2"] and steps.drop_derived("x2").derived() == []
    assert steps.drop_derived("x2").apply(raw).columns == ["x", "s"]
    assert same_rows(steps.reset().apply(raw), raw)
    with pytest.raises(ValueError):
        steps.drop_derived("x")
    with pytest.raises(ValueError):
        ts.Recipe.from_json('[{"op": "rm"}]')


def test_recipe_checkpoints_long_lineage(spark, monkeypatch):
    from tabspark.plans import recipe
    monkeypatch.setattr(recipe, "CHECKPOINT_EVERY", 2)
    raw = spark.range(100).select(F.col("id").cast("double").alias("x"))
    steps = ts.Recipe()
    for _ in range(5):
        steps = steps.clip_outliers(k=0.25)
    assert steps.apply(raw).agg(F.max("x")).first()[0] < 99


def test_project_keeps_raw(spark, x):
    project = ts.Project(x, ts.Recipe().fill_missing({"x": "median"}))
    assert project.working.filter("x is null").count() == 0 and project.raw.filter("x is null").count() == 1
    assert project.load(x).recipe.steps == []
    assert tuple(ts.delta(project.raw, clean.drop_null_target(x, "x")).first()) == (-1, 0)


def test_csv_with_line_breaks_is_split(spark, tmp_path):
    """Quoted line breaks, quotes and commas, over many splits of several files."""
    import csv
    rng = np.random.default_rng(1)
    bits = ["plain", "a, b", 'say ""so""'.replace('""', '"'), "two\nlines", "\n\n", "end\n", '"', "x" * 400, "r\r\nn", ""]
    want = []
    for f in range(3):
        with open(tmp_path / f"part-{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if f else "\r\n")
            writer.writerow(["id", "a text", "n"])
            for i in range(150):
                row = (1000 * f + i, " ".join(rng.choice(bits, 3)) + "|", int(rng.integers(9)))
                want.append(row)
                writer.writerow(row)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        from tabspark.sources.records import split_records
        assert split_records(spark, str(tmp_path)).select("file", "split").distinct().count() > 20
        got = ts.read_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, got)) == sorted(want)


def test_hot_values_do_not_meet_in_one_task(spark):
    """Without adaptive plans: no partition of the joined rows is much larger than the others."""
    rows = [(i, "hot" if i % 2 else "gone" if i % 5 == 0 else None if i % 7 == 0 else f"v{i:05}") for i in range(8000)]
    df = spark.createDataFrame(rows, "id int, tag string").repartition(4)
    known = sorted({t for _, t in rows if t not in (None, "gone")})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = prep.ordinal_encode(df, ["tag"], df.where("tag <> 'gone'"), listed=5, broadcast=5)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n")).collect()]
        codes = {r.id: r.tag for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = {t: float(i) for i, t in enumerate(known)}
    assert codes == {i: at.get(t, -1.0) for i, t in rows}
    assert len(sizes) == 4 and max(sizes) < 1.3 * len(rows) / 4


def test_heavy_values(spark):
    rows = [("a",)] * 900 + [("b",)] * 300 + [(f"x{i}",) for i in range(2000)] + [(None,)] * 500
    assert prep.heavy_values(spark.createDataFrame(rows, "v string").repartition(3), "v")[:2] == ["a", "b"]
    assert prep.heavy_values(spark.createDataFrame([], "v string"), "v") == []


def test_project_keeps_its_history(spark, tmp_path):
    runs = ts.Runs(spark, str(tmp_path))
    project = ts.Project(spark.range(3), ts.Recipe().derive("twice", "id * 2"), runs)
    again = project.load(spark.range(5))
    assert again.runs is runs and again.recipe.steps == [] and again.working.count() == 5
