"""Queries over units, canonical readings and registry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioquant.functions import units
from helioquant.functions.numeric import round_half_up
from helioquant.operators import canonical, dictionary, registry
from helioquant.plans import sqltext as q
from helioquant.plans.adapters import (
    ASSETS_SQL,
    GENERATION_SQL,
    UNIT_PAIRS,
    UNIT_TEXTS,
    dealt,
    flag,
    generation,
    k_number,
    plant_devices,
    table,
    ts_text,
)

RAW_COLUMNS = {"dc": "DC_POWER", "ac": "AC_POWER", "daily": "DAILY_YIELD", "total": "TOTAL_YIELD"}
LONG_IDS = ("reading_id", "plant", "device", "ts", "local_date")


# Units ------------------------------------------------------------------------------------------


def unit_names(spark, sf):
    texts = table(spark, sf, "events").select(
        "event_id", dealt(UNIT_TEXTS, F.col("event_id") + k_number()).alias("raw")
    )
    return texts.select(
        "event_id", "raw", F.coalesce(units.normalize_unit_expr("raw"), F.lit("")).alias("unit")
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _dealt_sql(options: tuple[str, ...], number: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {_sql_text(option)}" for i, option in enumerate(options)
    )
    return f"CASE ({number}) % {len(options)} {cases} END"


# The unit each of the dealt texts must come to, written out by hand.
UNITS_BY_TEXT = {
    "kW": "kW", " KW ": "kW", "mW": "MW", "W / m^2": "W/m²", "°C": "degC", "degrees c": "degC",
    "Fahrenheit": "degF", "deg  F": "degF", "K": "K", "watt-hours": "Wh", "MWh": "MWh",
}


def _unit_sql(text: str) -> str:
    pairs = " ".join(f"WHEN {_sql_text(t)} THEN {_sql_text(u)}" for t, u in UNITS_BY_TEXT.items())
    return f"CASE {text} {pairs} END"


def readings_in_units(spark, sf):
    pair = F.col("event_id") + k_number()
    rows = table(spark, sf, "events").select(
        "event_id",
        "value",
        dealt(tuple(p[0] for p in UNIT_PAIRS), pair).alias("unit"),
        dealt(tuple(p[1] for p in UNIT_PAIRS), pair).alias("target_unit"),
    )
    out = units.convert_readings(rows)
    return out.select(
        "event_id",
        round_half_up("converted", 6).alias("converted"),
        F.coalesce("conversion_error", F.lit("")).alias("conversion_error"),
    )


# What each dealt pair does to a value, or why it fails, written out by hand.
CONVERSIONS = (
    ("kW", "W", "value * 1000e0", ""), ("W", "kW", "value / 1000e0", ""), ("MW", "kw", "value * 1000e0", ""),
    ("kW", "GW", "", "no conversion on file"), ("Wh", "GWh", "", "no conversion on file"), ("MWh", "kWh", "value * 1000e0", ""),
    ("GWh", "kwh", "value * 1000000e0", ""), ("kW/m2", "W/m²", "value * 1000e0", ""),
    ("°F", "°C", "(value - 32e0) * (5e0 / 9e0)", ""), ("celsius", "K", "value + 273.15e0", ""),
    ("K", "fahrenheit", "(value - 273.15e0) * (9e0 / 5e0) + 32e0", ""), ("kW", "degC", "", "dimensions differ"),
    ("kWh", "W/m²", "", "dimensions differ"), ("horsepower", "W", "", "'horsepower' is not a unit spelling on file"),
    ("kW", "lightyears", "", "'lightyears' is not a unit spelling on file"), ("  ", "W", "", "no unit given (empty)"),
    ("w/m2", "W/m^2", "value", ""), ("degF", "kelvin", "(value - 32e0) * (5e0 / 9e0) + 273.15e0", ""),
)


def _conversion_sql() -> str:
    values = " ".join(f"WHEN {i} THEN {q.rounded(expr, 6)}" for i, (_, _, expr, _) in enumerate(CONVERSIONS) if expr)
    reasons = " ".join(f"WHEN {i} THEN {_sql_text(reason)}" for i, (_, _, _, reason) in enumerate(CONVERSIONS))
    return f"""
    WITH dealt AS (SELECT event_id, value, (event_id + {q.K}) % {len(CONVERSIONS)} AS i FROM events)
    SELECT event_id, CASE i {values} END AS converted, CASE i {reasons} END AS conversion_error FROM dealt"""


def converted_columns(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.col("value").alias("power"),
        F.col("value").alias("energy"),
        F.col("value").alias("irradiance"),
        F.col("value").alias("ambient"),
    )
    out = units.convert_columns(
        rows,
        {
            "power": ("kW", "W"),
            "energy": ("Wh", "kWh"),
            "irradiance": ("kw/m2", "W/m²"),
            "ambient": ("°F", "celsius"),
        },
    )
    return out.select(
        "event_id", *[round_half_up(c, 6).alias(c) for c in ("power", "energy", "irradiance", "ambient")]
    )


# Canonical readings -----------------------------------------------------------------------------


def _long(spark, sf):
    return canonical.to_long(generation(spark, sf), RAW_COLUMNS, LONG_IDS)


LONG_RAW_SQL = f"""
long AS (
  SELECT reading_id, plant, device, ts, local_date, 'DC_POWER' AS source_name, dc AS raw_value FROM generation
  UNION ALL SELECT reading_id, plant, device, ts, local_date, 'AC_POWER', ac FROM generation
  UNION ALL SELECT reading_id, plant, device, ts, local_date, 'DAILY_YIELD', daily FROM generation
  UNION ALL SELECT reading_id, plant, device, ts, local_date, 'TOTAL_YIELD', total FROM generation)"""


def long_readings(spark, sf):
    return _long(spark, sf).select("reading_id", "source_name", "raw_value")


TENTHS = "inverter_tenths"


def _device_channels(spark, sf):
    """Channels of the event devices; devices with an odd number report DC in tenths of kW."""
    users = table(spark, sf, "events").select("user_id").distinct()
    device = F.concat(F.lit("dev_"), F.col("user_id"))
    kind = F.when(F.col("user_id") % 2 == 1, F.lit(TENTHS)).otherwise(F.lit(registry.INVERTER))
    assets = users.select(
        registry.natural_id(device).alias("id"),
        F.lit("site").alias("plant_id"),
        device.alias("source_key"),
        kind.alias("asset_type"),
    )
    tenths = dictionary.channel_templates(spark, dictionary.DC_TENTHS_OF_KW)
    tenths = tenths.where(F.col("asset_type") == registry.INVERTER)
    return registry.build_channels(
        assets,
        dictionary.channel_templates(spark).unionByName(
            tenths.withColumn("asset_type", F.lit(TENTHS))
        ),
    )


def canonical_readings(spark, sf):
    out = canonical.canonicalize(_long(spark, sf), _device_channels(spark, sf))
    return out.select("reading_id", "signal_key", "unit", round_half_up("value", 4).alias("value"))


CANONICAL_SQL = f"""
WITH {GENERATION_SQL}, {LONG_RAW_SQL}
SELECT reading_id,
       CASE source_name WHEN 'DC_POWER' THEN 'power_dc' WHEN 'AC_POWER' THEN 'power_ac'
            WHEN 'DAILY_YIELD' THEN 'energy_ac_daily' ELSE 'energy_ac_total' END AS signal_key,
       CASE WHEN source_name IN ('DC_POWER', 'AC_POWER') THEN 'W' ELSE 'Wh' END AS unit,
       {q.rounded('''raw_value * CAST(CASE WHEN source_name = 'DC_POWER' AND CAST(substr(device, 5) AS BIGINT) % 2 = 1
                     THEN 100 ELSE 1000 END AS DOUBLE)''', 4)} AS value
FROM long"""


def channel_rollup(spark, sf):
    readings = canonical.canonicalize(
        _long(spark, sf), _device_channels(spark, sf), carry=("aggregation_method",)
    )
    out = canonical.rollup_channels(readings, interval_s=6 * 3600, decimals=1)
    return out.select(
        "device", "signal_key", "aggregation_method", ts_text("slot_start").alias("slot_start"),
        "n_readings", round_half_up("value", 1).alias("value"),
    )


CHANNEL_ROLLUP_SQL = f"""
WITH {GENERATION_SQL}, {LONG_RAW_SQL},
c AS (
  SELECT device, ts,
         CASE source_name WHEN 'DC_POWER' THEN 'power_dc' WHEN 'AC_POWER' THEN 'power_ac'
              WHEN 'DAILY_YIELD' THEN 'energy_ac_daily' ELSE 'energy_ac_total' END AS signal_key,
         CASE source_name WHEN 'DAILY_YIELD' THEN 'sum' WHEN 'TOTAL_YIELD' THEN 'last' ELSE 'avg' END AS m,
         raw_value * CAST(CASE WHEN source_name = 'DC_POWER' AND CAST(substr(device, 5) AS BIGINT) % 2 = 1
                          THEN 100 ELSE 1000 END AS DOUBLE) AS value FROM long)
SELECT device, signal_key, m AS aggregation_method,
       {q.ts_text("time_bucket(INTERVAL '6 hours', ts)")} AS slot_start, count(value) AS n_readings,
       {q.rounded(f"CASE m WHEN 'avg' THEN {q.mean('value', 1)} WHEN 'sum' THEN {q.total('value', 1)} ELSE max_by(value, ts) END", 1)} AS value
FROM c GROUP BY device, signal_key, m, time_bucket(INTERVAL '6 hours', ts)"""


def irradiance_tags(spark, sf):
    """Readings of power and irradiance channels; the even devices are stations."""
    rows = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("device"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("irradiance_poa"))
        .otherwise(F.lit("power_ac"))
        .alias("signal_key"),
    )
    stations = (
        rows.where((F.col("device") % 2 == 0) & (F.col("signal_key") == "irradiance_poa"))
        .select("device", "signal_key", (F.col("device") % 4 == 0).alias("approx_ghi"))
        .distinct()
    )
    tagged = canonical.tag_irradiance(rows, stations)
    return tagged.select("event_id", flag("approx_ghi").alias("approx_ghi"), flag("poa_assumed").alias("poa_assumed"))


def column_classes(spark, sf):
    """How the columns of the long readings (and one that nobody mapped) are classified."""
    long = _long(spark, sf).select(
        F.when(F.col("plant") == "error", F.lit("INVERTER_TEMP"))
        .when(F.col("plant") == "view", F.lit("SOURCE_KEY"))
        .otherwise(F.col("source_name"))
        .alias("source_name")
    )
    columns = long.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_readings"))
    out = canonical.classify_columns(columns, dictionary.raw_mapping(spark))
    return out.select(
        "source_name", "n_readings", "role", F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("unit", F.lit("")).alias("unit"),
    )


def _mapping_values() -> str:
    return ", ".join(
        f"({_sql_text(raw)}, {_sql_text(role)}, {_sql_text(target)}, {_sql_text(unit or '')})"
        for raw, role, target, unit, _ in dictionary.RAW_MAPPING
    )


# Registry ---------------------------------------------------------------------------------------


def _assets(spark, sf):
    return registry.build_assets(plant_devices(spark, sf))


def device_names(spark, sf):
    out = registry.device_names(plant_devices(spark, sf))
    return out.select("plant_id", "asset_type", "source_key", "device_index", "name")


def asset_tree(spark, sf):
    """Every asset with the name of its parent, found by the id link."""
    assets = _assets(spark, sf)
    parents = assets.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    out = assets.join(parents, "parent_id", "left")
    return out.select(
        "id", "plant_id", "name", "asset_type", F.coalesce("source_key", F.lit("")).alias("source_key"),
        F.coalesce("parent_name", F.lit("")).alias("parent_name"),
        round_half_up("rated_dc_w", 2).alias("rated_dc_w"), round_half_up("rated_ac_w", 2).alias("rated_ac_w"),
    )


def channel_expansion(spark, sf):
    channels = registry.build_channels(_assets(spark, sf), dictionary.channel_templates(spark))
    return channels.select(
        "device", "plant_id", "signal_key", "source_name", "source_unit", "interval_s",
        "aggregation_method", "scale_factor",
    )


def _channels_sql() -> str:
    factors = {raw: f for raw, _, _, _, f in dictionary.RAW_MAPPING}
    rows = ", ".join(
        f"('{kind}', '{signal}', '{raw}', '{unit}', {seconds}, '{method}', CAST({factors[raw]} AS DOUBLE))"
        for kind, signal, raw, unit, seconds, method in dictionary.CHANNEL_TEMPLATES
    )
    return f"""WITH {ASSETS_SQL},
    t(asset_type, signal_key, source_name, source_unit, interval_s, aggregation_method, scale_factor) AS (VALUES {rows})
    SELECT source_key AS device, plant_id, signal_key, source_name, source_unit, interval_s,
           aggregation_method, scale_factor FROM assets JOIN t USING (asset_type)"""


def mapped_devices(spark, sf):
    """Line items per named asset: the supplier key is the device's source key."""
    items = table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("device")),
        "l_suppkey",
    )
    # Readings collapse to devices before the names are attached.
    per_device = items.groupBy("device").agg(F.count(F.lit(1)).alias("n_readings"))
    out = registry.map_devices(per_device, _assets(spark, sf))
    return out.select("device", "asset_name", F.col("asset_plant_id").alias("plant_id"), "n_readings")


def _part_updates(spark, sf):
    """New prices for large parts, and parts not seen before (one per supplier)."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    priced = table(spark, sf, "part").where(F.col("p_size") > 40).select(
        "p_partkey", F.lit("Brand#new").alias("p_brand"), (F.col("p_retailprice") * 2).alias("p_retailprice")
    )
    added = table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("p_partkey"), F.lit("Brand#sup").alias("p_brand"),
        F.col("s_acctbal").alias("p_retailprice"),
    )
    return part, priced.unionByName(added)


def dictionary_upsert(spark, sf):
    part, updates = _part_updates(spark, sf)
    day = F.lit("2024-01-01")
    target = part.withColumns({"created_at": day, "updated_at": day})
    return registry.upsert(
        target, updates, ["p_partkey"], "created_at", "updated_at", F.lit("2024-06-01")
    )


def rows_if_absent(spark, sf):
    part, updates = _part_updates(spark, sf)
    return registry.insert_if_absent(part, updates, ["p_partkey"])


OFF_TYPES = ("ECONOMY", "PROMO")


def switched_keys(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", F.lit(True).alias("is_active"))
    out = registry.set_active(part, OFF_TYPES, False, key="p_type")
    return out.withColumn("is_active", flag("is_active"))


def restored_keys(spark, sf):
    part, updates = _part_updates(spark, sf)
    keyed = lambda df: df.withColumn("brand_key", F.col("p_brand"))
    changed = registry.upsert(part, updates, ["p_partkey"])
    return registry.restore(keyed(changed), keyed(part), ["Brand#1", "Brand#sup"], key="brand_key")


def _trade_tables(spark, sf):
    """Nations, customers and orders as plants, assets and channels."""
    plants = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.col("n_regionkey").cast("string").alias("organization_id"),
        F.col("n_name").alias("name"),
    )
    assets = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_nationkey").cast("string").alias("plant_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("c_mktsegment").alias("name"),
    )
    channels = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("asset_id"),
        F.col("o_orderpriority").alias("signal_key"),
    )
    return plants, assets, channels


GONE = ("3", "7", "11")


def cascade_delete(spark, sf):
    """What is left per table and plant once three plants are removed."""
    plants, assets, channels = registry.delete_cascade(*_trade_tables(spark, sf), GONE)
    owners = _trade_tables(spark, sf)[1].select(F.col("id").alias("asset_id"), "plant_id")
    counts = [
        plants.groupBy(F.col("id").alias("plant_id")).count().withColumn("kind", F.lit("plants")),
        assets.groupBy("plant_id").count().withColumn("kind", F.lit("assets")),
        channels.join(owners, "asset_id").groupBy("plant_id").count().withColumn("kind", F.lit("channels")),
    ]
    out = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return out.withColumnRenamed("count", "n_rows")


def plant_counts(spark, sf):
    _, assets, channels = _trade_tables(spark, sf)
    return registry.registry_counts(assets, channels)


KNOWN_SIGNALS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def constraint_violations(spark, sf):
    """Violations of the trade tables read as a registry: one priority is not in the dictionary."""
    plants, assets, channels = _trade_tables(spark, sf)
    known = channels.select("signal_key").distinct().where(F.col("signal_key").isin(*KNOWN_SIGNALS))
    return registry.check_constraints(plants, assets, channels, known)


QUERIES = {
    "unit_names": (
        unit_names,
        f"""WITH t AS (SELECT event_id, {_dealt_sql(UNIT_TEXTS, f'event_id + {q.K}')} AS raw FROM events)
        SELECT event_id, raw, coalesce({_unit_sql('raw')}, '') AS unit FROM t""",
    ),
    "convert_readings": (readings_in_units, _conversion_sql()),
    "convert_columns": (
        converted_columns,
        f"""SELECT event_id, {q.rounded('value * CAST(1000 AS DOUBLE)', 6)} AS power,
        {q.rounded('value / CAST(1000 AS DOUBLE)', 6)} AS energy,
        {q.rounded('value * CAST(1000 AS DOUBLE)', 6)} AS irradiance,
        {q.rounded('(value - CAST(32 AS DOUBLE)) * (CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE))', 6)} AS ambient FROM events""",
    ),
    "long_readings": (
        long_readings,
        f"WITH {GENERATION_SQL}, {LONG_RAW_SQL} SELECT reading_id, source_name, raw_value FROM long",
    ),
    "canonical_readings": (canonical_readings, CANONICAL_SQL),
    "channel_rollup": (channel_rollup, CHANNEL_ROLLUP_SQL),
    "irradiance_tags": (
        irradiance_tags,
        f"""WITH r AS (SELECT event_id, event_type IN ('click', 'view') AND user_id % 2 = 0 AS st, user_id FROM events)
        SELECT event_id, {q.flag('st AND user_id % 4 = 0')} AS approx_ghi, {q.flag('st')} AS poa_assumed FROM r""",
    ),
    "column_classes": (
        column_classes,
        f"""WITH {GENERATION_SQL}, {LONG_RAW_SQL},
        c AS (SELECT CASE plant WHEN 'error' THEN 'INVERTER_TEMP' WHEN 'view' THEN 'SOURCE_KEY' ELSE source_name END AS source_name,
                     count(*) AS n_readings FROM long GROUP BY 1),
        m(source_name, role, target, unit) AS (VALUES {_mapping_values()})
        SELECT source_name, n_readings, coalesce(role, 'unmapped') AS role, coalesce(target, '') AS target,
               coalesce(unit, '') AS unit FROM c LEFT JOIN m USING (source_name)""",
    ),
    "device_names": (
        device_names,
        f"""WITH {ASSETS_SQL} SELECT n.plant_id, n.asset_type, n.source_key, n.i AS device_index, a.name
        FROM named n JOIN assets a ON n.plant_id = a.plant_id AND n.asset_type = a.asset_type AND n.source_key = a.source_key""",
    ),
    "asset_tree": (
        asset_tree,
        f"""WITH {ASSETS_SQL} SELECT sha256(plant_id || '|' || asset_type || '|' || coalesce(source_key, name)) AS id, plant_id, name, asset_type,
        coalesce(source_key, '') AS source_key, CASE asset_type WHEN 'block' THEN '' ELSE 'Block-01' END AS parent_name,
        {q.rounded('rated_dc_w', 2)} AS rated_dc_w, {q.rounded('rated_ac_w', 2)} AS rated_ac_w FROM assets""",
    ),
    "channel_expansion": (channel_expansion, _channels_sql()),
    "map_devices": (
        mapped_devices,
        f"""WITH {ASSETS_SQL}
        SELECT s_name AS device, a.name AS asset_name, a.plant_id, count(*) AS n_readings
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN assets a ON a.source_key = s_name
        GROUP BY ALL""",
    ),
    "dictionary_upsert": (
        dictionary_upsert,
        """WITH u AS (SELECT p_partkey, 'Brand#new' AS p_brand, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size > 40
                      UNION ALL SELECT -1 - s_suppkey, 'Brand#sup', s_acctbal FROM supplier)
        SELECT coalesce(u.p_partkey, p.p_partkey) AS p_partkey, coalesce(u.p_brand, p.p_brand) AS p_brand,
               coalesce(u.p_retailprice, p.p_retailprice) AS p_retailprice,
               CASE WHEN p.p_partkey IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created_at,
               CASE WHEN u.p_partkey IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated_at
        FROM part p FULL JOIN u ON p.p_partkey = u.p_partkey""",
    ),
    "insert_if_absent": (
        rows_if_absent,
        """SELECT p_partkey, p_brand, p_retailprice FROM part
        UNION ALL SELECT -1 - s_suppkey, 'Brand#sup', s_acctbal FROM supplier""",
    ),
    "set_active": (
        switched_keys,
        f"""SELECT p_partkey, p_type, CASE WHEN p_type IN {OFF_TYPES} THEN 'false' ELSE 'true' END AS is_active FROM part""",
    ),
    "restore_snapshot": (
        restored_keys,
        """WITH c AS (
          SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Brand#new' ELSE p_brand END AS p_brand,
                 CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part)
        SELECT *, p_brand AS brand_key FROM c WHERE p_brand <> 'Brand#1'
        UNION ALL SELECT p_partkey, p_brand, p_retailprice, p_brand FROM part WHERE p_brand = 'Brand#1'""",
    ),
    "cascade_delete": (
        cascade_delete,
        """WITH n AS (SELECT CAST(n_nationkey AS VARCHAR) AS plant_id FROM nation WHERE n_nationkey NOT IN (3, 7, 11))
        SELECT plant_id, 1 AS n_rows, 'plants' AS kind FROM n
        UNION ALL SELECT plant_id, count(*), 'assets' FROM n JOIN customer ON CAST(c_nationkey AS VARCHAR) = plant_id GROUP BY plant_id
        UNION ALL SELECT plant_id, count(*), 'channels' FROM n JOIN customer ON CAST(c_nationkey AS VARCHAR) = plant_id
                  JOIN orders ON o_custkey = c_custkey GROUP BY plant_id""",
    ),
    "registry_counts": (
        plant_counts,
        """SELECT CAST(c_nationkey AS VARCHAR) AS plant_id, count(DISTINCT c_custkey) AS total_assets,
        count(o_orderkey) AS total_channels FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "constraint_violations": (
        constraint_violations,
        f"""SELECT 'asset_name_unique' AS "constraint", CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS key, count(*) AS n_rows
        FROM customer GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'plant_name_unique', n_regionkey || '|' || n_name, count(*) FROM nation GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'channel_signal_unique', CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority, count(*)
        FROM orders GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'channel_signal_exists', o_orderpriority, count(*) FROM orders
        WHERE o_orderpriority NOT IN {KNOWN_SIGNALS} GROUP BY ALL
        UNION ALL SELECT 'channel_asset_exists', CAST(o_custkey AS VARCHAR), count(*) FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL
        UNION ALL SELECT 'asset_plant_exists', CAST(c_nationkey AS VARCHAR), count(*) FROM customer
        WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY ALL""",
    ),
}
