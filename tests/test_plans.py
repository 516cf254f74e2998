"""Physical plans of the operators that carry the weight."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helioquant.functions.fixed import fixed_rows
from helioquant.functions.sequence import with_previous
from helioquant.functions.units import convert_readings
from helioquant.operators import profile, quality
from helioquant.sources.tables import write_laid_out


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.fixture
def readings(spark, frame, tmp_path):
    rows = [("p", f"d{i % 3}", s, f"2020-05-0{1 + i % 3} 10:00:00", "2020-05-01", float(i), i) for i, s in enumerate(["power_ac", "energy_ac_total", "energy_ac_daily"] * 4)]
    schema = "plant string, device string, signal_key string, ts timestamp, local_date date, value double, note long"
    frame(rows, schema).write.parquet(str(tmp_path / "r"))
    return spark.read.parquet(str(tmp_path / "r"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_look_back_shuffles_the_readings_once(readings, no_broadcast):
    text = plan(with_previous(readings, ["device"], ["value"]))
    # The join takes the window's output as it is: no exchange or sort in between.
    assert re.search(r"SortMergeJoin[^\n]*\n[ :+-]*Project[^\n]*\n[ :+-]*Window", text)
    # The carried rows come from a hash aggregate; the readings are read for them and for the rows.
    assert "HashAggregate(keys=[device" in text and "SortAggregate" not in text
    assert text.count("FileScan") == 2


def test_quality_pass_looks_back_once(spark, readings):
    bounds = fixed_rows(spark, [("p", "d0", "power_ac", 0.0, 1.0, True)], "plant string, device string, signal_key string, bound_min double, bound_max double, bounds_valid boolean")
    weather = readings.selectExpr("plant", "ts", "value AS irradiance")
    text = plan(quality.run_qc(readings, bounds, weather, arrival="note"))
    assert "Union" not in text
    assert text.count("FileScan") <= 4  # the readings for rows and for the ends of segments, by time and by arrival; the weather
    assert text.count("Exchange hashpartitioning") <= 8
    # Both counter rules read one look-back: a window by time, a window by arrival, and their carried ends.
    assert len(re.findall(r"\bWindow \[", text)) == 4


def test_laid_out_facts_need_no_exchange(spark, readings, no_broadcast):
    spark.sql("DROP TABLE IF EXISTS laid_out_readings")
    write_laid_out(readings, "laid_out_readings", buckets=4)
    try:
        facts = spark.table("laid_out_readings")
        assert facts.count() == readings.count()
        limits = spark.createDataFrame([("p", f"d{i}", 1.0) for i in range(3)], "plant string, device string, bound_max double")
        joined = plan(facts.join(limits, ["plant", "device"]))
        assert joined.count("Exchange") == 1  # the bounds alone
        counted = plan(facts.groupBy("plant", "device").agg({"value": "max"}))
        assert "Exchange" not in counted
        order = Window.partitionBy("plant", "device").orderBy("ts")
        assert "Exchange" not in plan(facts.withColumn("before", F.lag("value").over(order)))
    finally:
        spark.sql("DROP TABLE laid_out_readings")


def test_profiles_read_only_their_columns(readings):
    text = plan(profile.missing_days(readings))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {
        "struct<plant:string,device:string,ts:timestamp>", "struct<plant:string,ts:timestamp>",
    }
    assert "ReadSchema: struct<device:string>" in plan(profile.device_coverage(readings, 10))


def test_unit_lookup_needs_no_shuffle(readings):
    rows = readings.selectExpr("value", "'kW' || substr(device, 2, 0) AS unit", "'W' || substr(device, 2, 0) AS target_unit")
    text = plan(convert_readings(rows))
    assert text.count("BroadcastHashJoin") == 3 and "Exchange hashpartitioning" not in text


def test_quantiles_take_one_way_with_three_scans(readings):
    df = profile.device_ratings(readings.withColumnsRenamed({"value": "dc", "note": "ac"}))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "percentile(" not in final and final.count("FileScan") <= 3
