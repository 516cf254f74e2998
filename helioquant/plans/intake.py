"""Queries over feeds as they arrive: text reads, clocks, plant ids, added converters."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioquant.functions import units
from helioquant.functions.numeric import round_half_up
from helioquant.functions.timestamps import to_utc
from helioquant.operators import profile, registry
from helioquant.plans import sqltext as q
from helioquant.plans.adapters import BULK_SQL, GENERATION_SQL, bulk, dealt, generation, k_number, table, ts_text
from helioquant.plans.quality import written_feeds
from helioquant.sources import feeds


def text_feeds(spark, sf):
    """The CSV feeds with every column as text, as they stand in the files."""
    raw = feeds.read_feeds(spark, written_feeds(spark, sf))
    return raw.groupBy("feed", "SOURCE_KEY", F.coalesce("DC_POWER", F.lit("")).alias("DC_POWER")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("DATE_TIME").alias("first_text"),
        F.max("DATE_TIME").alias("last_text"),
        F.count("IRRADIATION").alias("n_irradiation"),
        F.max("PLANT_ID").alias("plant_id"),
    )


def feed_clocks(spark, sf):
    """The feeds' clocks checked from the time column alone."""
    out = feeds.verify_feeds(spark, written_feeds(spark, sf))
    return out.withColumns({c: ts_text(c) for c in ("earliest", "latest")})


# Zones of the plants; none of them moves its clock in the months of the data.
ZONES = {
    "click": "Asia/Kolkata", "error": "Asia/Kathmandu", "purchase": "UTC", "signup": "Asia/Tokyo",
    "view": "America/Phoenix",
}
# Minutes by which each zone's clock is ahead of UTC.
AHEAD = {"click": 330, "error": 345, "purchase": 0, "signup": 540, "view": -420}


def utc_times(spark, sf):
    zone = F.lit(None).cast("string")
    for plant, name in ZONES.items():
        zone = F.when(F.col("plant") == plant, F.lit(name)).otherwise(zone)
    return generation(spark, sf).select("reading_id", ts_text(to_utc("ts", zone)).alias("ts_utc"))


def clock_grid(spark, sf):
    """The readings' times by the minute against the quarter-hour grid."""
    rows = generation(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    return profile.clock_grid(rows)


CLOCK_GRID_SQL = f"""
WITH {GENERATION_SQL},
m AS (SELECT plant, device, date_trunc('minute', ts) AS t, extract('minute' FROM ts) % 15 AS o FROM generation),
s AS (SELECT plant, device, time_bucket(INTERVAL '15 minutes', t) AS s, count(*) AS n FROM m GROUP BY ALL),
g AS (SELECT plant, device, CAST(sum(n - 1) AS BIGINT) AS n_repeated,
             date_diff('minute', min(s), max(s)) // 15 + 1 - count(*) AS n_missing_slots FROM s GROUP BY ALL),
p AS (SELECT plant, device, count(*) AS n_readings, count(CASE WHEN o = 0 THEN 1 END) AS n_on_grid,
             count(CASE WHEN o > 0 THEN 1 END) AS n_off_grid, max(o) * CAST(60 AS DOUBLE) AS max_offset_s FROM m GROUP BY ALL)
SELECT plant, device, n_readings, 0 AS n_without_time, n_on_grid, n_off_grid, max_offset_s, n_repeated, n_missing_slots
FROM p JOIN g USING (plant, device)"""


def mapped_plants(spark, sf):
    """Line items by the plant that their supplier's number stands for; some numbers are not on the map."""
    plants = table(spark, sf, "nation").select(
        F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("raw_plant_id"), F.col("n_name").alias("plant")
    )
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 30).alias("plant_id"))
    # Readings collapse to ids before the map is joined.
    per_id = rows.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n_readings"))
    out = registry.map_plants(per_id, plants)
    return out.select("plant_id", F.coalesce("plant", F.lit("")).alias("plant"), "n_readings")


ADDED_PAIRS = (("MW", "GW"), ("Wh", "GWh"), ("kelvin", "K"), ("gw", "MW"), ("°C", "degF"))
ADDED = {
    ("MW", "GW"): units.Affine(div=1e3),
    ("Wh", "GWh"): lambda value: value / F.lit(1e9),
    # A stated pair that is replaced, and one in which nothing is to be done.
    ("degC", "degF"): lambda value: F.floor(value * F.lit(9.0) / F.lit(5.0)) + F.lit(32.0),
}


def added_converters(spark, sf):
    pair = F.col("event_id") + k_number()
    rows = table(spark, sf, "events").select(
        "event_id",
        "value",
        dealt(tuple(p[0] for p in ADDED_PAIRS), pair).alias("unit"),
        dealt(tuple(p[1] for p in ADDED_PAIRS), pair).alias("target_unit"),
    )
    out = units.convert_readings(rows, converters=ADDED)
    return out.select(
        "event_id", round_half_up("converted", 9).alias("converted"),
        F.coalesce("conversion_error", F.lit("")).alias("conversion_error"),
    )


def daily_slots(spark, sf):
    return profile.clock_grid(bulk(spark, sf), keys=("plant",), interval_s=86400)


QUERIES = {
    "text_feeds": (
        text_feeds,
        """WITH g AS (SELECT 'generation' AS feed, event_type AS k, CAST(value AS VARCHAR) AS dc, strftime(ts, '%d-%m-%Y %H:%M') AS t, 0 AS i FROM events
                   UNION ALL SELECT 'weather', event_type, '', strftime(ts, '%Y-%m-%d %H:%M:%S'), 1 FROM events)
        SELECT feed, k AS "SOURCE_KEY", dc AS "DC_POWER", count(*) AS n_rows, min(t) AS first_text, max(t) AS last_text,
               CAST(sum(i) AS BIGINT) AS n_irradiation, '1' AS plant_id FROM g GROUP BY ALL""",
    ),
    "feed_clocks": (
        feed_clocks,
        f"""SELECT 'generation' AS feed, '%d-%m-%Y %H:%M' AS format, '' AS style, count(*) AS total_rows, count(*) AS parsed,
               0 AS failed_or_null, {q.ts_text("date_trunc('minute', min(ts))")} AS earliest, {q.ts_text("date_trunc('minute', max(ts))")} AS latest FROM events
        UNION ALL SELECT 'weather', '%Y-%m-%d %H:%M:%S', '', count(*), count(*), 0,
               {q.ts_text("date_trunc('second', min(ts))")}, {q.ts_text("date_trunc('second', max(ts))")} FROM events""",
    ),
    "utc_times": (
        utc_times,
        f"""WITH {GENERATION_SQL}
        SELECT reading_id, {q.ts_text("ts - to_minutes(CAST(CASE plant " + " ".join(f"WHEN '{p}' THEN {m}" for p, m in AHEAD.items()) + " END AS INTEGER))")} AS ts_utc FROM generation""",
    ),
    "clock_grid": (clock_grid, CLOCK_GRID_SQL),
    "daily_slots": (
        daily_slots,
        f"""WITH {BULK_SQL}
        SELECT plant, count(*) AS n_readings, 0 AS n_without_time, count(*) AS n_on_grid, 0 AS n_off_grid, CAST(0 AS DOUBLE) AS max_offset_s,
               count(*) - count(DISTINCT ts) AS n_repeated,
               date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 - count(DISTINCT ts) AS n_missing_slots FROM bulk GROUP BY plant""",
    ),
    "map_plants": (
        mapped_plants,
        """SELECT l_suppkey % 30 AS plant_id, coalesce(any_value(n_name), '') AS plant, count(*) AS n_readings
        FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30 GROUP BY 1""",
    ),
    "added_converters": (
        added_converters,
        f"""WITH d AS (SELECT event_id, value, (event_id + {q.K}) % 5 AS i FROM events)
        SELECT event_id, CASE i WHEN 0 THEN {q.rounded('value / CAST(1000 AS DOUBLE)', 9)} WHEN 1 THEN {q.rounded('value / CAST(1000000000 AS DOUBLE)', 9)}
               WHEN 2 THEN {q.rounded('value', 9)} WHEN 4 THEN floor(value * CAST(9 AS DOUBLE) / CAST(5 AS DOUBLE)) + 32 END AS converted,
               CASE i WHEN 3 THEN 'no conversion on file' ELSE '' END AS conversion_error FROM d""",
    ),
}
