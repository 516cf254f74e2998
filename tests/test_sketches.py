from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from helioquant.operators import sketches

QUANTILES = {"p10": ("ac", 0.1), "p50": ("ac", 0.5), "p99": ("ac", 0.99)}


@pytest.fixture
def readings(spark):
    rows = spark.range(60_000)
    # Half of all rows belong to one feed and one device.
    return rows.select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 3)).alias("feed"),
        F.when(F.col("id") % 4 == 0, "d").otherwise(F.concat(F.lit("d"), F.col("id") % 20_000)).alias("device"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 10)).alias("ts"),
        (F.col("id") * 7919 % 60_013).cast("double").alias("ac"),
    )


def test_merged_days_are_within_the_stated_error(spark, readings, tmp_path):
    path = str(tmp_path / "days")
    sketches.write_days(sketches.daily_sketches(readings, ["ac"]), path)
    out = sketches.span_profile(sketches.read_days(spark, path), QUANTILES)
    exact = {r.feed: r for r in readings.groupBy("feed").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("device").alias("d"), F.collect_list("ac").alias("v")
    ).collect()}
    got = out.collect()
    assert len(got) == len(exact)
    for row in got:
        want = exact[row.feed]
        assert row.row_count == want.n and row.calendar_days == 7
        assert abs(row.distinct_devices - want.d) <= want.d * sketches.device_error() + 1
        for name, (_, p) in QUANTILES.items():
            below = sum(v <= row[name] for v in want.v) / want.n
            assert abs(below - p) <= 2 * sketches.rank_error() + 1 / want.n


def test_days_are_added_and_replaced_alone(spark, readings, tmp_path):
    path = str(tmp_path / "days")
    day = F.to_date("ts")
    sketches.write_days(sketches.daily_sketches(readings.where(day <= "2024-03-03"), ["ac"]), path)
    old = {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if "03-01" in f or "03-02" in f}
    # The third day again with fewer rows, and a new one.
    again = readings.where(day.isin("2024-03-03", "2024-03-04")).where("ac < 30000")
    sketches.write_days(sketches.daily_sketches(again, ["ac"]), path)
    assert old == {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in old}
    assert len(old) == 2
    rows = {str(r.log_date): r.n for r in sketches.read_days(spark, path).groupBy("log_date").agg(F.sum("row_count").alias("n")).collect()}
    assert rows["2024-03-01"] == 8640 and rows["2024-03-03"] == again.where(day == "2024-03-03").count()
    part = sketches.span_profile(sketches.read_days(spark, path, "2024-03-02", "2024-03-02")).agg(F.sum("row_count")).first()[0]
    assert part == 8640
    plan = sketches.read_days(spark, path, "2024-03-02", "2024-03-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_nulls_and_empty(spark, tmp_path):
    rows = [("f", None, None, None), ("f", "d", None, 1.0), ("g", None, "2024-01-01", None)]
    df = spark.createDataFrame(rows, "feed string, device string, t string, ac double").select("feed", "device", F.to_timestamp("t").alias("ts"), "ac")
    path = str(tmp_path / "days")
    sketches.write_days(sketches.daily_sketches(df, ["ac"]), path)
    out = {r.feed: r for r in sketches.span_profile(sketches.read_days(spark, path), {"p50": ("ac", 0.5)}).collect()}
    assert (out["f"].row_count, out["f"].distinct_devices, out["f"].calendar_days, out["f"].p50) == (2, 1, None, 1.0)
    assert (out["g"].row_count, out["g"].distinct_devices, out["g"].p50) == (1, 0, None)
    assert sketches.daily_sketches(df.limit(0), ["ac"]).count() == 0
