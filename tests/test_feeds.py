from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helioquant.functions import timestamps
from helioquant.sources import feeds, tables
from helioquant.sources.feeds import FeedSpec

HEAD = "DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER,DAILY_YIELD,TOTAL_YIELD\n"
WEATHER_HEAD = "DATE_TIME,PLANT_ID,SOURCE_KEY,AMBIENT_TEMPERATURE,MODULE_TEMPERATURE,IRRADIATION\n"


@pytest.fixture
def specs(tmp_path):
    a = tmp_path / "a.csv"
    a.write_text(
        HEAD + "15-05-2020 00:00,1,x,0.0,0.0,0.0,6259559\n"
        "15-05-2020 00:15,1,x,100,9.5,1.5,6259560.5\n"
        "2020-05-15 00:30:00,1,x,1,1,1,1\n"
        ",1,y,1,1,1,1\n"
        "16-05-2020 10:00,1,y,oops,1,1,1\n"
    )
    b = tmp_path / "b.csv"
    b.write_text(WEATHER_HEAD + "2020-05-15 00:00:00,1,w,25.1,22.8,0.0\n2020-05-16 12:00:00,1,w,30,50,1.2\n")
    return [
        FeedSpec("gen", str(a), timestamps.DAY_FIRST, "generation", "day first", plant="p1", timezone="Asia/Kolkata"),
        FeedSpec("wtr", str(b), timestamps.ISO_SECONDS, "weather", "ISO", plant="p1"),
    ]


def test_text_read_keeps_every_column_as_text(spark, specs):
    df = feeds.read_feed(spark, specs[0])
    assert [t for _, t in df.dtypes] == ["string"] * 8
    assert df.count() == 5
    assert df.where("DC_POWER = 'oops'").count() == 1


def test_typed_read(spark, specs):
    df = feeds.read_feed(spark, specs[0], typed=True)
    rows = df.orderBy("device", "ts_text").collect()
    assert len(rows) == 5
    first = [r for r in rows if r.ts_text == "15-05-2020 00:15"][0]
    assert (first.feed, first.plant, first.device, first.ac) == ("gen", "p1", "x", 9.5)
    assert str(first.ts) == "2020-05-15 00:15:00" and str(first.local_date) == "2020-05-15"
    # Local time is ahead of UTC: the UTC instant lies on the day before.
    assert str(first.ts_utc) == "2020-05-14 18:45:00"
    wrong_format = [r for r in rows if r.ts_text and r.ts_text.startswith("2020")][0]
    assert wrong_format.ts is None and wrong_format.dc == 1.0
    broken = [r for r in rows if r.corrupt_record is not None]
    assert len(broken) == 1 and "oops" in broken[0].corrupt_record


def test_strict_read_raises(spark, specs):
    with pytest.raises(PySparkException):
        feeds.read_feed(spark, specs[0], typed=True, strict=True).select("ts").collect()


def test_stacked_feeds(spark, specs):
    df = feeds.read_feeds(spark, specs, typed=True)
    assert {r.feed: r["count"] for r in df.groupBy("feed").count().collect()} == {"gen": 5, "wtr": 2}
    assert df.where("feed = 'wtr'").agg(F.max("irradiation")).first()[0] == 1.2


def test_foreign_header_is_an_error(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text(HEAD.replace("DC_POWER,AC_POWER", "AC_POWER,DC_POWER") + "15-05-2020 00:00,1,x,1,2,3,4\n")
    spec = FeedSpec("gen", str(path), timestamps.DAY_FIRST)
    with pytest.raises(Exception, match="CSV header does not conform"):
        feeds.read_feed(spark, spec, typed=True).collect()


def test_verification_counts_nulls_as_failures(spark, specs):
    rows = {r.feed: r for r in feeds.verify_feeds(spark, specs).collect()}
    gen = rows["gen"]
    assert (gen.total_rows, gen.parsed, gen.failed_or_null) == (5, 3, 2)
    assert str(gen.earliest) == "2020-05-15 00:00:00" and str(gen.latest) == "2020-05-16 10:00:00"
    assert gen.format == "%d-%m-%Y %H:%M" and rows["wtr"].failed_or_null == 0


def test_samples(spark, specs):
    frames = {s.label: feeds.time_texts(spark, s).where("ts_text IS NOT NULL") for s in specs}
    out = feeds.raw_samples(frames, n=2).collect()
    assert sorted(r.raw_sample for r in out if r.feed == "gen") == ["15-05-2020 00:00", "15-05-2020 00:15"]
    assert len(out) == 4


def test_time_scan_is_pruned(spark, specs, capsys):
    feeds.time_texts(spark, specs[0]).explain()
    assert "ReadSchema: struct<DATE_TIME:string>" in capsys.readouterr().out


def test_stream_of_files(spark, specs, tmp_path):
    stream = feeds.read_feed_stream(spark, FeedSpec("gen", str(tmp_path / "a*.csv"), timestamps.DAY_FIRST))
    out = str(tmp_path / "out")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_patterns():
    assert timestamps.spark_pattern("%d-%m-%Y %H:%M") == "dd-MM-yyyy HH:mm"
    assert timestamps.spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert timestamps.spark_pattern("yyyy") == "yyyy"
    with pytest.raises(ValueError):
        timestamps.spark_pattern("%Q")


def test_slots_and_days(frame):
    df = frame([("2020-05-15 10:14:59", "2020-05-17 00:00:00")], "a timestamp, b timestamp")
    row = df.select(
        timestamps.slot("a").alias("s"), timestamps.calendar_days("a", "b").alias("d"),
        timestamps.date_text("a").alias("t"), timestamps.epoch_micros("a").alias("m"),
    ).first()
    assert str(row.s) == "2020-05-15 10:00:00" and row.d == 3 and row.t == "2020-05-15"
    assert row.m == 1589537699000000
    assert timestamps.hours_per_slot() == 0.25


def test_facts_are_partitioned_and_pruned(spark, specs, tmp_path, capsys):
    df = feeds.read_feed(spark, specs[0], typed=True).where("local_date IS NOT NULL")
    tables.write_facts(df, str(tmp_path / "facts"))
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert back.count() == df.count()
    back.where("plant = 'p1' AND local_date = DATE'2020-05-16'").explain()
    assert "PartitionFilters: [isnotnull(plant" in capsys.readouterr().out


def test_dimension_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    tables.write_dim(df, str(tmp_path / "dim"))
    assert tables.read_dim(spark, str(tmp_path / "dim")).collect() == df.collect()


def test_routes_split_without_loss(spark, tmp_path):
    df = spark.createDataFrame([(1, []), (2, ["F"]), (3, None)], "i int, qc_flags array<string>")
    valid, dead = tables.route_readings(df)
    assert sorted(r.i for r in valid.collect()) == [1, 3]
    assert [r.i for r in dead.collect()] == [2]
    tables.write_routed(df, str(tmp_path / "r"))
    assert {(r.i, r.route) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {
        (1, "valid"), (3, "valid"), (2, "dead_letter"),
    }
