from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helioquant.functions import quantiles
from helioquant.functions.quantiles import grouped_percentiles
from helioquant.functions.sequence import ordered_text, with_previous


def skewed(spark, n=6000, seed=5):
    """One device holds most rows, and most of those fall on one day."""
    rng = random.Random(seed)
    rows = []
    seconds = rng.sample(range(40 * 86400), n)
    for i, s in enumerate(seconds):
        device = "hot" if i % 10 < 7 else f"d{i % 5}"
        if device == "hot" and i % 3:
            s = 86400 + (s % 86400)
        rows.append((i, device, s, rng.random() * 100))
    df = spark.createDataFrame(rows, "id int, device string, s long, value double")
    return df.withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("unit", [3_600_000_000, 86_400_000_000, 10**15])
def test_previous_is_the_plain_window(spark, unit):
    df = skewed(spark)
    plain = Window.partitionBy("device").orderBy("ts", "id")
    want = df.withColumn("want", F.lag("value").over(plain)).select("id", "want")
    got = with_previous(df, ["device"], ["value", "id"], tie_breakers=["id"], unit=unit)
    assert got.columns == [*df.columns, "prev_value", "prev_id"]
    joined = got.join(want, "id")
    assert joined.count() == df.count()
    assert joined.where(~F.col("want").eqNullSafe(F.col("prev_value"))).count() == 0


def test_rows_without_a_place_stay(spark, frame):
    rows = [("a", "2020-01-01 00:00:00", 1.0), ("a", None, 2.0), ("a", "2020-01-09 00:00:00", 3.0),
            (None, "2020-01-01 00:00:00", 4.0), (None, "2020-01-02 00:00:00", 5.0)]
    df = frame(rows, "device string, ts timestamp, value double")
    out = {r.value: r.prev_value for r in with_previous(df, ["device"], ["value"]).collect()}
    assert out == {1.0: None, 2.0: None, 3.0: 1.0, 4.0: None, 5.0: None}


def test_null_previous_value_is_not_skipped(frame):
    rows = [("a", "2020-01-01 00:00:00", 1.0), ("a", "2020-01-01 01:00:00", None), ("a", "2020-01-03 00:00:00", 3.0)]
    df = frame(rows, "device string, ts timestamp, value double")
    out = {str(r.ts): r.prev_value for r in with_previous(df, ["device"], ["value"]).collect()}
    assert out == {"2020-01-01 00:00:00": None, "2020-01-01 01:00:00": 1.0, "2020-01-03 00:00:00": None}


def test_times_before_1970(frame):
    rows = [("a", "1969-12-30 23:00:00", 1.0), ("a", "1969-12-31 23:00:00", 2.0), ("a", "1970-01-01 01:00:00", 3.0)]
    df = frame(rows, "device string, ts timestamp, value double")
    for unit in (3_600_000_000, 86_400_000_000):
        out = {r.value: r.prev_value for r in with_previous(df, ["device"], ["value"], unit=unit).collect()}
        assert out == {1.0: None, 2.0: 1.0, 3.0: 2.0}


def test_ordered_text_quotes_its_separator(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "o int, p string")
    assert df.agg(ordered_text("p", "o", "'").alias("t")).first().t == "a'b"


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_hot_groups_get_exact_quantiles(spark, accuracy):
    df = skewed(spark).select(
        "device",
        # Many ties at zero, an outlier, and nulls.
        F.when(F.col("id") % 4 == 0, F.lit(0.0))
        .when(F.col("id") == 17, F.lit(2.24e9))
        .when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.col("value"))
        .alias("value"),
        F.col("s").cast("double").alias("other"),
    )
    df = df.unionByName(spark.createDataFrame([("empty", None, 1.0)] * 9, "device string, value double, other double"))
    spec = {
        "lo": ("value", 0.0), "p05": ("value", 0.05), "p50": ("value", 0.5), "p99": ("value", 0.99),
        "hi": ("value", 1.0), "o50": ("other", 0.5),
    }
    extra = [F.count("value").alias("n")]
    key = lambda r: r.device or ""
    plain = df.groupBy("device").agg(*extra, *[F.percentile(c, F.lit(p)).alias(name) for name, (c, p) in spec.items()])
    got = grouped_percentiles(df, ["device"], spec, extra, accuracy=accuracy)
    assert got.columns == plain.columns
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key)


def test_many_small_groups_take_the_same_plan(spark, capsys):
    small = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.rand(3).alias("v"))
    hot = spark.range(3000).select(F.floor(F.col("id") / 1_000_000).alias("k"), F.rand(3).alias("v"))
    shapes = []
    for df in (small, hot):
        got = grouped_percentiles(df, ["k"], {"m": ("v", 0.5), "t": ("v", 0.9)}, accuracy=100)
        got.explain()
        text = capsys.readouterr().out
        shapes.append([line.split("(")[0].strip(" +-:*") for line in text.splitlines() if "Exchange" in line or "Join" in line])
        # The sketch, and the placed values twice, each time with the sketch's table: adaptive
        # execution runs equal exchanges once.
        assert text.count("Range (") <= 5
        plain = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("t"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert shapes[0] == shapes[1]


def test_quantiles_of_null_keys(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(50)], "k string, v double")
    assert grouped_percentiles(df, ["k"], {"m": ("v", 0.5)}).collect()[0].m == 24.5
    approx = grouped_percentiles(df, ["k"], {"m": ("v", 0.5)}, approx=True).collect()[0].m
    assert abs(approx - 24.5) <= 1


def test_quantile_arguments(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    with pytest.raises(ValueError):
        grouped_percentiles(df, [], {"m": ("v", 0.5)})
    with pytest.raises(ValueError):
        grouped_percentiles(df, ["k"], {"m": ("v", 1.5)})


def test_large_and_small_groups_get_the_same_quantiles(spark, monkeypatch):
    """Values of a large group are not dealt out by group: the few cut points go to them."""
    monkeypatch.setattr(quantiles, "LARGE_GROUP", 40)
    group = F.when(F.col("id") % 10 < 7, F.lit("large")).when(F.col("id") % 10 < 8, F.concat(F.lit("g"), F.col("id") % 50))
    df = spark.range(1000).select(group.alias("k"), (F.col("id") * 37 % 211 / 8).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("w"))
    spec = {"a": ("v", 0.5), "b": ("v", 0.99), "c": ("w", 0.25)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = grouped_percentiles(df, ["k"], spec)
        assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2
        rows = {r.k: (r.a, r.b, r.c) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.99)).alias("b"), F.percentile("w", F.lit(0.25)).alias("c"))
    want = {r.k: (r.a, r.b, r.c) for r in want.collect()}
    assert None in want and "large" in want and len(want) > 5
    assert {k: pytest.approx(x) for k, x in want.items()} == rows
