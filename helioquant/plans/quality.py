"""Queries over bounds, flags, routing, availability, and the streaming forms."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where, round_half_up, total
from helioquant.functions.timestamps import DAY_FIRST, ISO_SECONDS, SECONDS_PER_DAY
from helioquant.operators import dictionary, quality
from helioquant.plans import sqltext as q
from helioquant.plans.adapters import (
    BOUNDS_SQL,
    LONG_SQL,
    SITE_WEATHER_SQL,
    as_long_readings,
    day_text,
    device_assets,
    device_channels,
    flag,
    long_readings,
    site_weather,
    table,
    ts_text,
)
from helioquant.plans.telemetry import DAILY_DROP_SQL, weather_of_errors
from helioquant.session import checkpoint_dir
from helioquant.sources import feeds, tables
from helioquant.streaming import energy as stream_energy
from helioquant.streaming import merge as stream_merge
from helioquant.streaming import order as stream_order
from helioquant.streaming import quality as stream_quality

DECIMALS = 2
DAY_SLOTS = SECONDS_PER_DAY // 900


def _bounds(spark, sf):
    assets = device_assets(spark, sf)
    return quality.resolve_bounds(
        dictionary.canonical_signals(spark, with_wind=True), assets, device_channels(assets)
    )


def resolved_bounds(spark, sf):
    return _bounds(spark, sf).select(
        "device", "signal_key",
        F.coalesce(F.col("bound_min"), F.lit(-1.0)).alias("bound_min"),
        F.coalesce(round_half_up("bound_max", 6), F.lit(-1.0)).alias("bound_max"),
        F.col("bounds_valid").cast("string").alias("bounds_valid"),
    )


def _ranged(spark, sf):
    return quality.qc_range(long_readings(spark, sf), _bounds(spark, sf))


def range_flags(spark, sf):
    return _ranged(spark, sf).select("reading_id", F.array_join("qc_flags", ",").alias("qc_flags"))


RANGE_SQL = """
ranged AS (
  SELECT r.*, CASE WHEN ok IS NOT TRUE THEN 'QC_FLAG_NO_BOUNDS' WHEN value > hi THEN 'QC_FLAG_OUT_OF_BOUNDS_HIGH'
              WHEN value < lo THEN 'QC_FLAG_OUT_OF_BOUNDS_LOW' END AS range_flag
  FROM readings r LEFT JOIN bounds USING (device, signal_key))"""


def routed_counts(spark, sf):
    valid, dead = tables.route_readings(_ranged(spark, sf))
    parts = [
        df.groupBy("device").agg(F.count(F.lit(1)).alias("n_readings")).withColumn("route", F.lit(r))
        for r, df in ((tables.VALID, valid), (tables.DEAD_LETTER, dead))
    ]
    return parts[0].unionByName(parts[1])


def scorecard(spark, sf):
    out = quality.qc_summary(_ranged(spark, sf)).drop("plant")
    return out.withColumn("local_date", day_text("local_date"))


def _checked(spark, sf):
    return quality.run_qc(
        long_readings(spark, sf), _bounds(spark, sf), site_weather(spark, sf), arrival="ingest_seq"
    )


CHECKED_SQL = f"""
{LONG_SQL}, {SITE_WEATHER_SQL}, {BOUNDS_SQL}, {RANGE_SQL},
sun AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, max(irradiance) AS g FROM site_weather GROUP BY 1),
stepped AS (
  SELECT r.*, value < lag(value) OVER (PARTITION BY device, signal_key ORDER BY ts) AS fell,
         value < lag(value) OVER (PARTITION BY device, signal_key, local_date ORDER BY ts) AS fell_today,
         ts <= lag(ts) OVER (PARTITION BY device, signal_key ORDER BY ingest_seq) AS late, g
  FROM ranged r LEFT JOIN sun ON s = time_bucket(INTERVAL '15 minutes', ts)),
checked AS (
  SELECT *, concat_ws(',', range_flag,
     CASE WHEN signal_key = 'energy_ac_total' AND fell THEN 'QC_MONOTONIC_INCREASING' END,
     CASE WHEN signal_key = 'energy_ac_daily' AND fell_today AND g > 0 THEN 'QC_FLAG_DAILY_ENERGY_DROP' END,
     CASE WHEN late THEN 'QC_FLAG_NOT_CHRONOLOGICAL' END) AS flags,
     signal_key = 'energy_ac_daily' AND coalesce(fell_today, false) AND g IS NULL AS unknown_drop
  FROM stepped)"""


def full_pass(spark, sf):
    return _checked(spark, sf).select(
        "reading_id",
        F.array_join("qc_flags", ",").alias("qc_flags"),
        F.col("daily_drop_unknown").cast("string").alias("daily_drop_unknown"),
    )


REPORT_FLAGS = {
    "n_high": quality.FLAG_HIGH,
    "n_low": quality.FLAG_LOW,
    "n_no_bounds": quality.FLAG_NO_BOUNDS,
    "n_counter_fell": "QC_MONOTONIC_INCREASING",
    "n_daily_drop": "QC_FLAG_DAILY_ENERGY_DROP",
    "n_out_of_order": "QC_FLAG_NOT_CHRONOLOGICAL",
}


def device_day_report(spark, sf):
    """Per device-day: readings, coverage, integrated energy and readings per quality flag."""
    power = F.when(F.col("signal_key") == "power_ac", F.col("value"))
    energy = F.coalesce(total(power, DECIMALS) * F.lit(0.25), F.lit(0.0))
    out = (
        _checked(spark, sf)
        .groupBy("device", "local_date")
        .agg(
            F.count(F.lit(1)).alias("n_readings"),
            energy.alias("integrated_kwh"),
            *[
                count_where(F.array_contains("qc_flags", f)).alias(name)
                for name, f in REPORT_FLAGS.items()
            ],
        )
    )
    coverage = F.lit(100.0) * F.col("n_readings") / F.lit(DAY_SLOTS)
    return out.withColumn("coverage_pct", round_half_up(coverage, 2)).withColumn(
        "local_date", day_text("local_date")
    )


def device_availability(spark, sf):
    """Power readings against the irradiance of the site; ratings by user number."""
    readings = long_readings(spark, sf).where(F.col("signal_key") == "power_ac")
    ratings = device_assets(spark, sf).select("plant", "device", (F.col("rated_ac_w") * 50).alias("rated_ac_w"))
    sun = site_weather(spark, sf).withColumn("irradiance", F.col("irradiance") * 10)
    out = quality.availability(readings, sun, ratings, ac="value")
    return out.select(
        "device", day_text("log_date").alias("log_date"), "daylight_slots", "down_slots",
        "unknown_slots", round_half_up("availability", 4).alias("availability"),
    )


AVAILABILITY_SQL = f"""
WITH {LONG_SQL}, {SITE_WEATHER_SQL}, {BOUNDS_SQL},
sun AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, max(irradiance * 10) AS g FROM site_weather GROUP BY 1),
slots AS (SELECT device, time_bucket(INTERVAL '15 minutes', ts) AS s, max(value) AS ac
          FROM readings WHERE signal_key = 'power_ac' GROUP BY ALL),
judged AS (
  SELECT device, CAST(s AS DATE) AS d, g IS NOT NULL AND r IS NOT NULL AS known, g > 50 AS sunny,
         ac < CAST(0.01 AS DOUBLE) * (r * 50) AS low
  FROM slots LEFT JOIN sun USING (s) LEFT JOIN rated USING (device)),
days AS (
  SELECT device, d, count(CASE WHEN known AND sunny THEN 1 END) AS daylight_slots,
         count(CASE WHEN known AND sunny AND low THEN 1 END) AS down_slots,
         count(CASE WHEN NOT known THEN 1 END) AS unknown_slots FROM judged GROUP BY ALL)
SELECT device, {q.day_text('d')} AS log_date, daylight_slots, down_slots, unknown_slots,
       {q.rounded('CAST(1 AS DOUBLE) - down_slots / CAST(nullif(daylight_slots, 0) AS DOUBLE)', 4)} AS availability
FROM days"""


# Streams: each drains the events file as a stream and returns what the sink holds. ----------------


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


@contextmanager
def _state_partitions(spark):
    """A stream that starts here keeps its state in one partition a core, which go with its checkpoint.

    Every partition of every stateful step opens and commits its stores in each micro-batch, whatever
    they hold: partitions beyond the cores only add to that.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _drain(spark, writer_of):
    """Run a stream to the end of its input into a fresh folder of the shared checkpoint place."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = writer_of(f"{base}/out", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{base}/out"


def streamed_routing(spark, sf):
    def writer(path, state):
        stream = as_long_readings(_event_stream(spark, sf))
        routed = stream_quality.stream_qc(stream, _bounds(spark, sf))
        return stream_quality.routed_writer(routed, path, state)

    out = spark.read.parquet(_drain(spark, writer))
    return out.select("reading_id", "route", F.array_join("qc_flags", ",").alias("qc_flags"))


def _keyed_state(spark):
    """Keyed timers need the store that build_session sets; sessions built elsewhere may lack it."""
    spark.conf.set(*stream_order.STATE_PROVIDER)


def _drain_in_parts(spark, parts, writer_of):
    """Bring the parts (folder name to rows) in one after another, draining the stream after each.

    Every drain starts a new query from the checkpoint of the one before, as after a restart.
    """
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schemas = {name: rows.schema for name, rows in parts[0].items()}
    for part in parts:
        for name, rows in part.items():
            rows.write.mode("append").parquet(f"{base}/in/{name}")
        streams = {name: spark.readStream.schema(s).parquet(f"{base}/in/{name}") for name, s in schemas.items()}
        with _state_partitions(spark):
            query = writer_of(streams, f"{base}/out", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return f"{base}/out"


def _appended(rows, path, state):
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append")


def _heartbeat(rows, lateness_s=0):
    """A row of no plant far beyond the others: it moves the watermark past all of them."""
    later = F.max("ts") + F.expr("INTERVAL 60 DAYS") + F.make_dt_interval(secs=F.lit(lateness_s))
    names = [f for f in rows.schema.fields if f.name not in ("plant", "ts")]
    return rows.agg(later.alias("ts")).select(
        F.lit("heartbeat").alias("plant"), "ts", *[F.lit(0).cast(f.dataType).alias(f.name) for f in names]
    ).select(*rows.columns)


def _arrived(event_id):
    """Arrival numbers that leave the order of time by up to some sixty places."""
    return event_id + event_id % 7 * 11


def _series(spark, sf):
    return table(spark, sf, "events").select(
        F.lit("site").alias("plant"),
        F.concat(F.lit("dev_"), F.col("user_id")).alias("device"),
        F.col("event_type").alias("signal_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        _arrived(F.col("event_id")).alias("ingest_seq"),
    )


def _lateness_s(rows, part, least_s=4 * SECONDS_PER_DAY):
    """Seconds by which a row comes after a later one of an earlier part: a stream that waits less would drop it."""
    micros = F.unix_micros("ts")
    spans = rows.groupBy(part.alias("part")).agg(F.min(micros).alias("low"), F.max(micros).alias("high"))
    lateness, newest = least_s, None
    for _, low, high in sorted(tuple(r) for r in spans.where("part IS NOT NULL AND low IS NOT NULL").collect()):
        if newest is not None:
            lateness = max(lateness, (newest - low) // 1_000_000 + 1)
        newest = high if newest is None else max(newest, high)
    return lateness


def streamed_order(spark, sf):
    """Readings in three drains by arrival, a heartbeat at the end: both order rules on the stream."""
    _keyed_state(spark)
    rows = _series(spark, sf)
    last = rows.agg(F.max("ingest_seq")).first()[0]
    third = F.floor(F.col("ingest_seq") * 3 / (last + 1))
    parts = [{"readings": rows.where(third == k)} for k in range(3)]
    lateness_s = _lateness_s(rows, third)
    parts[-1]["readings"] = parts[-1]["readings"].unionByName(_heartbeat(rows, lateness_s))

    def writer(streams, path, state):
        return _appended(stream_order.stream_order_checks(streams["readings"], lateness=f"{lateness_s} seconds"), path, state)

    return spark.read.parquet(_drain_in_parts(spark, parts, writer))


def streamed_steps(spark, sf):
    return streamed_order(spark, sf).select(
        "device", "signal_key", ts_text("ts").alias("ts"), round_half_up("step", 4).alias("step"),
        F.when(F.array_contains("qc_flags", "QC_MONOTONIC_INCREASING"), F.lit("QC_MONOTONIC_INCREASING")).otherwise(F.lit("")).alias("qc_flag"),
    )


def streamed_order_flags(spark, sf):
    return streamed_order(spark, sf).select(
        "plant", "device", "signal_key", "arrival", F.array_join("qc_flags", ",").alias("qc_flags")
    )


def streamed_daily_drop(spark, sf):
    """The daily-drop rule with readings and irradiance as streams, in three drains."""
    _keyed_state(spark)
    readings = table(spark, sf, "events").where(F.col("event_type") != "error").select(
        F.col("event_type").alias("plant"), F.concat(F.lit("dev_"), F.col("user_id")).alias("device"),
        F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("ingest_seq"),
    )
    weather = weather_of_errors(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = readings.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in range(1, 3)]

    def part(rows, k):
        low = rows if k == 0 else rows.where(F.col("ts") >= cuts[k - 1])
        return low if k == 2 else low.where(F.col("ts") < cuts[k])

    parts = [{"readings": part(readings, k), "weather": part(weather, k)} for k in range(3)]
    for name, rows in (("readings", readings), ("weather", weather)):
        parts[-1][name] = parts[-1][name].unionByName(_heartbeat(rows))

    def writer(streams, path, state):
        return _appended(stream_order.stream_daily_drop(streams["readings"], streams["weather"]), path, state)

    out = spark.read.parquet(_drain_in_parts(spark, parts, writer))
    return out.select(
        F.col("arrival").alias("reading_id"), flag("daily_drop").alias("daily_drop"), F.coalesce("qc_flag", F.lit("")).alias("qc_flag")
    )


def streamed_energy(spark, sf):
    """Every device-day, those still open included, merged from the changes of each micro-batch."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("plant"), F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ac")
    )
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = first + (last - first) / 2
    parts = [{"readings": rows.where(F.col("ts") < middle)}, {"readings": rows.where(F.col("ts") >= middle)}]

    def writer(streams, path, state):
        return stream_merge.batch_writer(stream_energy.stream_daily_energy(streams["readings"], decimals=DECIMALS), path, state)

    out = stream_merge.latest(spark, _drain_in_parts(spark, parts, writer), ["plant", "device", "log_date"])
    return out.withColumn("log_date", day_text("log_date"))


# Files: written from the tables into a fresh shared folder and read back. -------------------------


def written_feeds(spark, sf):
    """Two CSV feeds with different clocks, written out, and their specifications."""
    rows = table(spark, sf, "events")
    base = f"{checkpoint_dir(spark)}/feeds-{uuid.uuid4().hex}"
    day_first, iso = "dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss"
    value = F.col("value")
    rows.select(
        F.date_format("ts", day_first).alias("DATE_TIME"), F.lit(1).alias("PLANT_ID"),
        F.col("event_type").alias("SOURCE_KEY"), value.alias("DC_POWER"), value.alias("AC_POWER"),
        value.alias("DAILY_YIELD"), value.alias("TOTAL_YIELD"),
    ).write.option("header", True).csv(f"{base}/generation")
    rows.select(
        F.date_format("ts", iso).alias("DATE_TIME"), F.lit(1).alias("PLANT_ID"),
        F.col("event_type").alias("SOURCE_KEY"), value.alias("AMBIENT_TEMPERATURE"),
        value.alias("MODULE_TEMPERATURE"), value.alias("IRRADIATION"),
    ).write.option("header", True).csv(f"{base}/weather")
    return [
        feeds.FeedSpec("generation", f"{base}/generation", DAY_FIRST, "generation"),
        feeds.FeedSpec("weather", f"{base}/weather", ISO_SECONDS, "weather"),
    ]


def csv_feeds(spark, sf):
    """The written feeds read through their specifications."""
    specs = written_feeds(spark, sf)
    return (
        feeds.read_feeds(spark, specs, typed=True)
        .groupBy("feed", "device", "local_date")
        .agg(
            F.count("ts").alias("n_readings"),
            F.count("corrupt_record").alias("n_corrupt"),
            ts_text(F.max("ts")).alias("last_ts"),
            total(F.coalesce("ac", "irradiation"), DECIMALS).alias("value_sum"),
        )
        .withColumn("local_date", day_text("local_date"))
    )


def stored_facts(spark, sf):
    """Checked readings written by route and as facts by plant and day, then read back."""
    base = f"{checkpoint_dir(spark)}/facts-{uuid.uuid4().hex}"
    tables.write_routed(_ranged(spark, sf), f"{base}/routed")
    routed = spark.read.parquet(f"{base}/routed")
    tables.write_facts(routed, f"{base}/facts")
    return (
        tables.read_dim(spark, f"{base}/facts")
        .groupBy("route", "local_date")
        .agg(F.count(F.lit(1)).alias("n_readings"), F.sum(F.size("qc_flags")).alias("n_flags"))
        .withColumn("local_date", day_text("local_date"))
    )


QUERIES = {
    "csv_feeds": (
        csv_feeds,
        f"""SELECT 'generation' AS feed, event_type AS device, {q.day_text('CAST(ts AS DATE)')} AS local_date,
               count(*) AS n_readings, 0 AS n_corrupt, {q.ts_text("date_trunc('minute', max(ts))")} AS last_ts,
               {q.total('value')} AS value_sum FROM events GROUP BY event_type, CAST(ts AS DATE)
        UNION ALL
        SELECT 'weather', event_type, {q.day_text('CAST(ts AS DATE)')}, count(*), 0,
               {q.ts_text("date_trunc('second', max(ts))")}, {q.total('value')}
        FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    ),
    "stored_facts": (
        stored_facts,
        f"""WITH {LONG_SQL}, {BOUNDS_SQL}, {RANGE_SQL}
        SELECT CASE WHEN range_flag IS NULL THEN 'valid' ELSE 'dead_letter' END AS route,
               {q.day_text('local_date')} AS local_date, count(*) AS n_readings, count(range_flag) AS n_flags
        FROM ranged GROUP BY ALL""",
    ),
    "device_day_report": (
        device_day_report,
        f"""WITH {CHECKED_SQL}
        SELECT device, {q.day_text('local_date')} AS local_date, count(*) AS n_readings,
               coalesce({q.total("CASE WHEN signal_key = 'power_ac' THEN value END")} * CAST(0.25 AS DOUBLE), 0) AS integrated_kwh,
               {", ".join(f"count(CASE WHEN contains(flags, '{f}') THEN 1 END) AS {name}" for name, f in REPORT_FLAGS.items())},
               {q.rounded(f'CAST(100 AS DOUBLE) * count(*) / {DAY_SLOTS}', 2)} AS coverage_pct
        FROM checked GROUP BY device, local_date""",
    ),
    "qc_full_pass": (
        full_pass,
        f"WITH {CHECKED_SQL} SELECT reading_id, flags AS qc_flags, CAST(unknown_drop AS VARCHAR) AS daily_drop_unknown FROM checked",
    ),
    "resolved_bounds": (
        resolved_bounds,
        f"""WITH {BOUNDS_SQL} SELECT device, signal_key, lo AS bound_min,
        coalesce({q.rounded('hi', 6)}, -1) AS bound_max, CAST(ok AS VARCHAR) AS bounds_valid FROM bounds""",
    ),
    "qc_range": (
        range_flags,
        f"WITH {LONG_SQL}, {BOUNDS_SQL}, {RANGE_SQL} SELECT reading_id, coalesce(range_flag, '') AS qc_flags FROM ranged",
    ),
    "route_readings": (
        routed_counts,
        f"""WITH {LONG_SQL}, {BOUNDS_SQL}, {RANGE_SQL}
        SELECT device, CASE WHEN range_flag IS NULL THEN 'valid' ELSE 'dead_letter' END AS route,
               count(*) AS n_readings FROM ranged GROUP BY ALL""",
    ),
    "qc_summary": (
        scorecard,
        f"""WITH {LONG_SQL}, {BOUNDS_SQL}, {RANGE_SQL}
        SELECT device, {q.day_text('local_date')} AS local_date, signal_key, range_flag AS qc_flag, count(*) AS n_readings
        FROM ranged WHERE range_flag IS NOT NULL GROUP BY ALL""",
    ),
    "availability": (device_availability, AVAILABILITY_SQL),
    "stream_qc": (
        streamed_routing,
        f"""WITH {LONG_SQL}, {BOUNDS_SQL}, {RANGE_SQL}
        SELECT reading_id, CASE WHEN range_flag IS NULL THEN 'valid' ELSE 'dead_letter' END AS route,
               coalesce(range_flag, '') AS qc_flags FROM ranged""",
    ),
    "stream_monotonic": (
        streamed_steps,
        f"""WITH s AS (
          SELECT 'dev_' || user_id AS device, event_type AS signal_key, ts,
                 value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS step FROM events)
        SELECT device, signal_key, {q.ts_text('ts')} AS ts, {q.rounded('step', 4)} AS step,
               CASE WHEN step < 0 THEN 'QC_MONOTONIC_INCREASING' ELSE '' END AS qc_flag FROM s""",
    ),
    "stream_order_checks": (
        streamed_order_flags,
        f"""WITH s AS (
          SELECT event_id + event_id % 7 * 11 AS arrival, 'dev_' || user_id AS device, event_type AS signal_key, value, ts, user_id, event_type FROM events),
        judged AS (
          SELECT *, value < lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, arrival) AS fell,
                 ts <= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY arrival) AS late FROM s)
        SELECT 'site' AS plant, device, signal_key, arrival,
               concat_ws(',', CASE WHEN fell THEN 'QC_MONOTONIC_INCREASING' END, CASE WHEN late THEN 'QC_FLAG_NOT_CHRONOLOGICAL' END) AS qc_flags
        FROM judged""",
    ),
    "stream_daily_drop": (streamed_daily_drop, DAILY_DROP_SQL),
    "stream_daily_energy": (
        streamed_energy,
        f"""SELECT event_type AS plant, user_id AS device, {q.day_text('CAST(ts AS DATE)')} AS log_date,
               {q.total('value')} * CAST(0.25 AS DOUBLE) AS integrated_kwh, count(value) AS n_readings
        FROM events GROUP BY event_type, user_id, CAST(ts AS DATE)""",
    ),
}
