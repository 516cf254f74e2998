"""Fixed reference rows: canonical signals, raw-column mapping, channel templates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from helioquant.functions.fixed import fixed_rows

SIGNAL_SCHEMA = (
    "signal_key string, display_name string, category string, unit string, data_type string, "
    "monotonicity string, bound_min_rule string, bound_max_rule string, is_active boolean, "
    "description string"
)

DAILY_COUNTER = "energy_ac_daily"
LIFETIME_COUNTER = "energy_ac_total"
IRRADIANCE = "irradiance_poa"

# Key, name, category, unit, monotonicity, least and greatest allowed value.
SOLAR_SIGNALS = (
    ("power_dc", "DC Power Generation", "power", "W", "none", "0.0", "1.20 * device.rated_dc_w"),
    ("power_ac", "AC Power Generation", "power", "W", "none", "0.0", "1.10 * device.rated_ac_w"),
    ("energy_ac_daily", "Daily AC Energy Yield", "energy", "Wh", "daily_reset", "0.0",
     "24.0 * device.rated_ac_w"),
    ("energy_ac_total", "Lifetime Total AC Energy Yield", "energy", "Wh", "strict_increasing",
     "0.0", "None"),
    ("irradiance_poa", "Plane of Array Irradiance", "weather", "W/m²", "none", "0.0", "1500.0"),
    ("irradiance_ghi", "Global Horizontal Irradiance", "weather", "W/m²", "none", "0.0", "1361.0"),
    ("temperature_ambient", "Ambient Air Temperature", "weather", "degC", "none", "-30.0", "60.0"),
    ("temperature_module", "PV Module Temperature", "weather", "degC", "none", "-20.0", "90.0"),
)

# Wind signals, kept in the dictionary but inactive for solar plants.
WIND_KEYS = (
    "wind_speed",
    "wind_direction",
    "rotor_speed",
    "pitch_angle",
    "yaw_angle",
    "generator_speed",
    "gearbox_temperature",
    "nacelle_position",
)

# Raw column -> (signal or dimension, target unit, factor).
# DC_POWER of a feed in tenths of kW needs 100, of a feed in kW 1000.
RAW_MAPPING = (
    ("DATE_TIME", "dimension", "timestamp", None, None),
    ("PLANT_ID", "dimension", "plant_id", None, None),
    ("SOURCE_KEY", "dimension", "device_id", None, None),
    ("DC_POWER", "signal", "power_dc", "W", 1000.0),
    ("AC_POWER", "signal", "power_ac", "W", 1000.0),
    ("DAILY_YIELD", "signal", "energy_ac_daily", "Wh", 1000.0),
    ("TOTAL_YIELD", "signal", "energy_ac_total", "Wh", 1000.0),
    ("AMBIENT_TEMPERATURE", "signal", "temperature_ambient", "degC", 1.0),
    ("MODULE_TEMPERATURE", "signal", "temperature_module", "degC", 1.0),
    ("IRRADIATION", "signal", "irradiance_poa", "W/m²", 1000.0),
)
DC_TENTHS_OF_KW = 100.0

# Asset type, signal, raw column, raw unit, seconds per interval, method.
CHANNEL_TEMPLATES = (
    ("inverter", "power_dc", "DC_POWER", "kW", 900, "avg"),
    ("inverter", "power_ac", "AC_POWER", "kW", 900, "avg"),
    ("inverter", "energy_ac_daily", "DAILY_YIELD", "kWh", 900, "sum"),
    ("inverter", "energy_ac_total", "TOTAL_YIELD", "kWh", 900, "last"),
    ("weather_station", "irradiance_poa", "IRRADIATION", "kW/m²", 900, "avg"),
    ("weather_station", "temperature_ambient", "AMBIENT_TEMPERATURE", "degC", 900, "avg"),
    ("weather_station", "temperature_module", "MODULE_TEMPERATURE", "degC", 900, "avg"),
)


def canonical_signals(spark: SparkSession, with_wind: bool = False) -> DataFrame:
    """The signal dictionary; with the inactive wind keys on request."""
    rows = [
        (key, name, category, unit, "float", monotonicity, low, high, True, name)
        for key, name, category, unit, monotonicity, low, high in SOLAR_SIGNALS
    ]
    if with_wind:
        rows += [
            (key, key, "wind", "", "float", "none", None, None, False, key) for key in WIND_KEYS
        ]
    return fixed_rows(spark, rows, SIGNAL_SCHEMA)


def raw_mapping(spark: SparkSession, dc_factor: float = 1000.0) -> DataFrame:
    rows = [
        (raw, role, key, unit, dc_factor if raw == "DC_POWER" else factor)
        for raw, role, key, unit, factor in RAW_MAPPING
    ]
    return fixed_rows(
        spark,
        rows,
        "source_name string, role string, target string, unit string, scale_factor double",
    )


def channel_templates(spark: SparkSession, dc_factor: float = 1000.0) -> DataFrame:
    """Channels each asset type gets, with the factor to the canonical unit."""
    factors = {raw: factor for raw, _, _, _, factor in RAW_MAPPING} | {"DC_POWER": dc_factor}
    units = {raw: unit for raw, _, _, unit, _ in RAW_MAPPING}
    dc_unit = "deci-kW" if dc_factor == DC_TENTHS_OF_KW else "kW"
    rows = [
        (
            kind, signal, raw, dc_unit if raw == "DC_POWER" else unit, seconds, method,
            factors[raw], units[raw], signal == IRRADIANCE,
        )
        for kind, signal, raw, unit, seconds, method in CHANNEL_TEMPLATES
    ]
    return fixed_rows(
        spark,
        rows,
        "asset_type string, signal_key string, source_name string, source_unit string, "
        "interval_s int, aggregation_method string, scale_factor double, target_unit string, "
        "approx_ghi boolean",
    )


# Integer plant ids of the feeds and the plant they stand for.
PLANT_IDS = (("4135001", "surya_a"),)


def plant_ids(spark: SparkSession, pairs: Iterable[tuple[str, str]] = PLANT_IDS) -> DataFrame:
    """The plant-id map as a table: (raw_plant_id, plant)."""
    return fixed_rows(spark, list(pairs), "raw_plant_id string, plant string")
