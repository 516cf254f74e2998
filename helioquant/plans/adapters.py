"""The driver tables in the shape of telemetry, registry and call-log tables.

Thin projections only: every row of the source table comes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.operators.calllog import COMPLETIONS_VENDOR, MESSAGES_VENDOR
from helioquant.operators.registry import INVERTER, STATION

PLANTS = ("click", "error", "purchase", "signup", "view")

# Unit texts dealt out to readings: known spellings, traps and failures.
UNIT_TEXTS = (
    "kW", " KW ", "mW", "W / m^2", "°C", "degrees c", "degrees celsius", "gigawatt-hours",
    "deci-kW", "unobtainium", "   ", "Fahrenheit", "deg  F", "K", "watt-hours", "MWh",
)
UNIT_PAIRS = (
    ("kW", "W"), ("W", "kW"), ("MW", "kw"), ("kW", "GW"), ("Wh", "GWh"), ("MWh", "kWh"),
    ("GWh", "kwh"), ("kW/m2", "W/m²"), ("°F", "°C"), ("celsius", "K"), ("K", "fahrenheit"),
    ("kW", "degC"), ("kWh", "W/m²"), ("horsepower", "W"), ("kW", "lightyears"), ("  ", "W"),
    ("w/m2", "W/m^2"), ("degF", "kelvin"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def flag(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def k_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def arrival_number(row: Column) -> Column:
    """A distinct arrival number per row that leaves the order of time in places."""
    return row + row % 7 * 1001


def dealt(options: tuple[str, ...], number: Column) -> Column:
    """An option per row, by a number of the row."""
    chosen = F.when(F.pmod(number, F.lit(len(options))) == 0, F.lit(options[0]))
    for i, option in enumerate(options[1:], 1):
        chosen = chosen.when(F.pmod(number, F.lit(len(options))) == i, F.lit(option))
    return chosen


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as device readings: plant, device, time, AC, DC and two counters."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("reading_id"),
        F.col("event_type").alias("plant"),
        F.concat(F.lit("dev_"), F.col("user_id")).alias("device"),
        "ts",
        F.to_date("ts").alias("local_date"),
        (F.col("value") + k_number()).alias("dc"),
        F.col("value").alias("ac"),
        F.col("value").alias("daily"),
        F.col("value").alias("total"),
        k_number().alias("k"),
    )


GENERATION_SQL = r"""
generation AS (
  SELECT event_id AS reading_id, event_type AS plant, 'dev_' || user_id AS device, ts,
         CAST(ts AS DATE) AS local_date,
         value + CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS dc,
         value AS ac, value AS daily, value AS total,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k
  FROM events)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as weather readings: irradiation in kW/m² and irradiance in W/m²."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("plant"),
        F.col("event_type").alias("station"),
        "ts",
        (k_number() / F.lit(100.0)).alias("irradiation"),
        (k_number() * F.lit(10.0)).alias("irradiance"),
    )


WEATHER_SQL = r"""
weather AS (
  SELECT event_type AS plant, event_type AS station, ts,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) / CAST(100 AS DOUBLE) AS irradiation,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) * CAST(10 AS DOUBLE) AS irradiance
  FROM events)"""


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the large reading table: device = supplier, power = price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("plant"),
        F.concat(F.lit("sup_"), F.col("l_suppkey")).alias("device"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("dc"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("ac"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


BULK_SQL = """
bulk AS (
  SELECT l_returnflag AS plant, 'sup_' || l_suppkey AS device, l_shipdate AS ts,
         l_extendedprice AS dc,
         l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) AS ac,
         l_extendedprice AS price, l_quantity AS quantity
  FROM lineitem)"""


def long_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long_readings(table(spark, sf_dir, "events"))


def as_long_readings(events: DataFrame) -> DataFrame:
    """Events as canonical readings of four signals: power and the two counters."""
    signal = (
        F.when(F.col("event_type") == "click", F.lit("power_dc"))
        .when(F.col("event_type") == "view", F.lit("power_ac"))
        .when(F.col("event_type") == "purchase", F.lit("energy_ac_daily"))
        .when(F.col("event_type") == "signup", F.lit("energy_ac_total"))
        .otherwise(F.lit("gearbox_temperature"))
    )
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.lit("site").alias("plant"),
        F.concat(F.lit("dev_"), F.col("user_id")).alias("device"),
        signal.alias("signal_key"),
        "ts",
        F.to_date("ts").alias("local_date"),
        F.col("value"),
        arrival_number(F.col("event_id")).alias("ingest_seq"),
    )


LONG_SQL = r"""
readings AS (
  SELECT event_id AS reading_id, 'site' AS plant, 'dev_' || user_id AS device,
         CASE event_type WHEN 'click' THEN 'power_dc' WHEN 'view' THEN 'power_ac'
              WHEN 'purchase' THEN 'energy_ac_daily' WHEN 'signup' THEN 'energy_ac_total'
              ELSE 'gearbox_temperature' END AS signal_key,
         ts, CAST(ts AS DATE) AS local_date, value,
         event_id + event_id % 7 * 1001 AS ingest_seq
  FROM events)"""


def site_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irradiance of the one site: error events, so that many slots have none."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(F.lit("site").alias("plant"), "ts", (k_number() - F.lit(50)).cast("double").alias("irradiance"))
    )


SITE_WEATHER_SQL = r"""
site_weather AS (
  SELECT 'site' AS plant, ts,
         CAST(CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) - 50 AS DOUBLE) AS irradiance
  FROM events WHERE event_type = 'error')"""


def device_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per reporting user, rated by its user number; every seventh has no rating."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    rated = F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 100 + 20).cast("double"))
    return users.select(
        F.concat(F.lit("asset_"), F.col("user_id")).alias("id"),
        F.lit("site").alias("plant"),
        F.concat(F.lit("dev_"), F.col("user_id")).alias("device"),
        rated.alias("rated_dc_w"),
        rated.alias("rated_ac_w"),
    )


def device_channels(assets: DataFrame) -> DataFrame:
    """Four channels per asset, with its ratings."""
    signals = ("power_dc", "power_ac", "energy_ac_daily", "energy_ac_total")
    return assets.select(
        F.col("id").alias("asset_id"),
        "plant",
        "device",
        "rated_dc_w",
        "rated_ac_w",
        F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal_key"),
    )


# The bounds of those channels, written out: coefficient times rating, or unbounded.
BOUNDS_SQL = """
users AS (SELECT DISTINCT user_id FROM events),
rated AS (
  SELECT 'dev_' || user_id AS device,
         CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 100 + 20 AS DOUBLE) END AS r FROM users),
bounds AS (
  SELECT device, 'power_dc' AS signal_key, CAST(0 AS DOUBLE) AS lo, CAST(1.2 AS DOUBLE) * r AS hi,
         r IS NOT NULL AS ok FROM rated
  UNION ALL SELECT device, 'power_ac', 0, CAST(1.1 AS DOUBLE) * r, r IS NOT NULL FROM rated
  UNION ALL SELECT device, 'energy_ac_daily', 0, CAST(24 AS DOUBLE) * r, r IS NOT NULL FROM rated
  UNION ALL SELECT device, 'energy_ac_total', 0, NULL, true FROM rated)"""


def plant_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry input: nations as plants, suppliers as inverters, customers as stations."""
    inverters = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("plant_id"),
        F.col("s_name").alias("source_key"),
        F.lit(INVERTER).alias("asset_type"),
        F.col("s_acctbal").alias("rated_dc_kwp"),
        (F.col("s_acctbal") / F.lit(2.0)).alias("rated_ac_kw"),
    )
    stations = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("plant_id"),
        F.col("c_name").alias("source_key"),
        F.lit(STATION).alias("asset_type"),
        F.lit(None).cast("double").alias("rated_dc_kwp"),
        F.lit(None).cast("double").alias("rated_ac_kw"),
    )
    return inverters.unionByName(stations)


ASSETS_SQL = """
devices AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS plant_id, s_name AS source_key,
         'inverter' AS asset_type, s_acctbal AS dc, s_acctbal / CAST(2 AS DOUBLE) AS ac
  FROM supplier
  UNION ALL
  SELECT CAST(c_nationkey AS VARCHAR), c_name, 'weather_station', NULL, NULL FROM customer),
named AS (
  SELECT *, row_number() OVER (PARTITION BY plant_id, asset_type ORDER BY source_key) AS i
  FROM devices),
assets AS (
  SELECT plant_id, asset_type, source_key,
         CASE asset_type WHEN 'inverter' THEN 'INV-' ELSE 'WS-' END
           || CASE WHEN i < 10 THEN '0' ELSE '' END || CAST(i AS VARCHAR) AS name,
         dc * CAST(1000 AS DOUBLE) AS rated_dc_w, ac * CAST(1000 AS DOUBLE) AS rated_ac_w
  FROM named
  UNION ALL
  SELECT DISTINCT plant_id, 'block', NULL, 'Block-01', NULL, NULL FROM devices)"""


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as recorded responses of both vendors, built by Spark from their texts.

    Even conversations are logged in the first vendor's form, odd ones in the second's; turns
    divisible by three carry a tool call.
    """
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    even = F.col("conv_id") % 2 == 0
    has_tool = F.col("turn") % 3 == 0
    n_in, n_out = F.length("text"), F.size(F.split("text", " "))
    zone = F.when(F.col("turn") == 3, F.lit("timezone")).otherwise(F.lit("tz"))
    arguments = F.create_map(zone, F.lit("UTC"))
    tool_id = F.concat(F.lit("t_"), F.col("conv_id"), F.lit("_"), F.col("turn"))
    text_block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    null_map = F.lit(None).cast("map<string,string>")
    none = F.lit(None).cast("string")
    block_text = F.struct(
        text_block["type"].alias("type"), text_block["text"].alias("text"),
        none.alias("id"), none.alias("name"), null_map.alias("input"),
    )
    block_tool = F.struct(
        F.lit("tool_use").alias("type"), none.alias("text"), tool_id.alias("id"),
        F.lit("get_current_time").alias("name"), arguments.alias("input"),
    )
    body_a = F.to_json(
        F.struct(
            F.lit("model-a").alias("model"),
            F.when(has_tool, F.array(block_text, block_tool)).otherwise(F.array(block_text)).alias("content"),
            F.when(has_tool, F.lit("tool_use")).otherwise(F.lit("end_turn")).alias("stop_reason"),
            F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens")).alias("usage"),
        )
    )
    call = F.struct(
        tool_id.alias("id"),
        F.struct(
            F.lit("get_current_time").alias("name"),
            # One text in four is cut off, as a broken log would have it.
            F.when(F.col("turn") == 0, F.lit('{"timezone": ')).otherwise(F.to_json(arguments)).alias("arguments"),
        ).alias("function"),
    )
    body_b = F.to_json(
        F.struct(
            F.lit("model-b").alias("model"),
            F.array(
                F.struct(
                    F.struct(
                        F.col("text").alias("content"),
                        F.when(has_tool, F.array(call)).otherwise(F.array().cast(
                            "array<struct<id:string,function:struct<name:string,arguments:string>>>"
                        )).alias("tool_calls"),
                    ).alias("message"),
                    F.when(has_tool, F.lit("tool_calls")).otherwise(F.lit("length")).alias("finish_reason"),
                )
            ).alias("choices"),
            F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens")).alias("usage"),
        )
    )
    return turns.select(
        F.concat("conv_id", F.lit("_"), "turn").alias("call_id"),
        F.when(even, F.lit(MESSAGES_VENDOR)).otherwise(F.lit(COMPLETIONS_VENDOR)).alias("provider"),
        F.when(F.col("turn") == 7, F.lit(503)).otherwise(F.lit(200)).alias("http_status"),
        F.when(even, body_a).otherwise(body_b).alias("body"),
        (F.length("text") / F.lit(4.0)).alias("latency_ms"),
    )


# The same turns with the fields the normalised record must have.
CALLS_SQL = """
calls AS (
  SELECT conv_id || '_' || turn AS call_id,
         CASE WHEN conv_id % 2 = 0 THEN 'anthropic' ELSE 'openai_compatible' END AS provider,
         CASE WHEN conv_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
         turn <> 7 AS usable, turn % 3 = 0 AS has_tool, turn, conv_id, text,
         length(text) AS n_in, len(string_split(text, ' ')) AS n_out,
         CASE WHEN turn % 3 = 0 THEN 'tool_use' WHEN conv_id % 2 = 0 THEN 'end_turn'
              ELSE 'max_tokens' END AS stop_reason,
         length(text) / CAST(4 AS DOUBLE) AS latency_ms
  FROM conversations WHERE role = 'assistant')"""


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recorded streams: each turn is a text piece and a tool-argument piece.

    The lines of a call: a start line, two lines per turn, a closing line, an end marker, and a
    line after it that must not count.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    even = F.col("conv_id") % 2 == 0
    provider = F.when(even, F.lit(MESSAGES_VENDOR)).otherwise(F.lit(COMPLETIONS_VENDOR))
    piece = F.concat(F.lit('"'), F.col("turn"), F.lit('":'), F.length("text"), F.lit(","))

    def data(payload: Column) -> Column:
        return F.concat(F.lit("data: "), payload)

    text_a = F.to_json(
        F.struct(
            F.lit("content_block_delta").alias("type"),
            F.struct(F.lit("text_delta").alias("type"), F.col("text").alias("text")).alias("delta"),
        )
    )
    args_a = F.to_json(
        F.struct(
            F.lit("content_block_delta").alias("type"),
            F.struct(F.lit("input_json_delta").alias("type"), piece.alias("partial_json")).alias("delta"),
        )
    )
    text_b = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))
    )

    def calls_b(arguments: Column, call_id: Column, name: Column) -> Column:
        call = F.struct(
            F.lit(0).alias("index"), call_id.alias("id"),
            F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"),
        )
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("delta"))).alias("choices")))

    none = F.lit(None).cast("string")
    body = turns.select(
        F.col("conv_id").cast("string").alias("call_id"),
        provider.alias("provider"),
        F.explode(
            F.array(
                F.struct((F.col("turn") * 2 + 10).alias("seq"), data(F.when(even, text_a).otherwise(text_b)).alias("line")),
                F.struct((F.col("turn") * 2 + 11).alias("seq"), data(F.when(even, args_a).otherwise(calls_b(piece, none, none))).alias("line")),
            )
        ).alias("l"),
    ).select("call_id", "provider", "l.seq", "l.line")

    per_call = turns.groupBy("conv_id").agg(F.max("turn").alias("t"), F.count(F.lit(1)).alias("n"))
    open_b = calls_b(F.lit("{"), F.concat(F.lit("c_"), F.col("conv_id")), F.lit("lookup"))
    start_a = F.concat(F.lit('{"type":"message_start","message":{"usage":{"input_tokens":'), F.col("n"), F.lit("}}}"))
    tool_a = F.concat(
        F.lit('{"type":"content_block_start","content_block":{"type":"tool_use","id":"c_'),
        F.col("conv_id"), F.lit('","name":"lookup"}}'),
    )
    brace_a = F.lit('{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"{"}}')
    last_a = F.lit('{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"\\"end\\":0}"}}')
    stop_a = F.lit('{"type":"content_block_stop"}')
    done_a = F.concat(F.lit('{"type":"message_delta","delta":{"stop_reason":"tool_use"},"usage":{"output_tokens":'), F.col("t"), F.lit("}}"))
    last_b = calls_b(F.lit('"end":0}'), none, none)
    done_b = F.concat(
        F.lit('{"choices":[{"delta":{},"finish_reason":"tool_calls"}],"usage":{"prompt_tokens":'),
        F.col("n"), F.lit(',"completion_tokens":'), F.col("t"), F.lit("}}"),
    )
    end = F.col("t") * 2 + 12

    def at(seq: Column, a: Column, b: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), data(F.when(even, a).otherwise(b)).alias("line"))

    noise = F.lit("not json")
    frame = per_call.select(
        F.col("conv_id").cast("string").alias("call_id"),
        provider.alias("provider"),
        F.explode(
            F.array(
                at(F.lit(0), start_a, noise),
                at(F.lit(1), tool_a, open_b),
                at(F.lit(2), brace_a, noise),
                at(end, last_a, last_b),
                at(end + 1, stop_a, noise),
                at(end + 2, done_a, done_b),
                at(end + 3, F.lit("[DONE]"), F.lit("[DONE]")),
                at(end + 4, F.lit('{"type":"content_block_delta","delta":{"type":"text_delta","text":"late"}}'),
                   F.lit('{"choices":[{"delta":{"content":"late"}}]}')),
            )
        ).alias("l"),
    ).select("call_id", "provider", "l.seq", "l.line")
    return body.unionByName(frame)
