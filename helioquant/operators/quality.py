"""Bounds, range checks, the combined quality pass, availability, and the scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where, ratio
from helioquant.functions.timestamps import local_date, slot
from helioquant.functions.sequence import with_previous
from helioquant.operators.counters import (
    FLAG_DAILY_DROP,
    FLAG_MONOTONIC,
    irradiance_by_slot,
    qc_chronology,
)
from helioquant.operators.dictionary import DAILY_COUNTER, LIFETIME_COUNTER

FLAG_HIGH = "QC_FLAG_OUT_OF_BOUNDS_HIGH"
FLAG_LOW = "QC_FLAG_OUT_OF_BOUNDS_LOW"
FLAG_NO_BOUNDS = "QC_FLAG_NO_BOUNDS"

#: What a reading is matched with its bounds by. A device key belongs to one plant only by chance.
CHANNEL = ("plant", "device", "signal_key")

# The three forms a bound rule can take.
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
LITERAL_RULE = rf"^\s*({NUMBER})\s*$"
SCALED_RULE = rf"^\s*({NUMBER})\s*\*\s*device\.([A-Za-z_]\w*)\s*$"
UNBOUNDED = "None"

# Down means irradiance above 50 W/m² with less than 1 % of rated AC power.
DAYLIGHT_W_M2 = 50.0
DOWN_SHARE = 0.01


def bound_value(rule: Column, attributes: Column) -> tuple[Column, Column]:
    """(bound, valid) of a rule text. Text is matched, never evaluated."""
    literal = F.nullif(F.regexp_extract(rule, LITERAL_RULE, 1), F.lit(""))
    coefficient = F.nullif(F.regexp_extract(rule, SCALED_RULE, 1), F.lit(""))
    attribute = F.regexp_extract(rule, SCALED_RULE, 2)
    value = F.coalesce(
        literal.cast("double"),
        coefficient.cast("double") * F.try_element_at(attributes, attribute),
    )
    unbounded = rule.isNull() | (F.trim(rule) == UNBOUNDED)
    return F.when(~unbounded, value), unbounded | value.isNotNull()


def resolve_bounds(
    dictionary: DataFrame,
    assets: DataFrame,
    channels: DataFrame,
    attributes: Sequence[str] = ("rated_dc_w", "rated_ac_w"),
    keys: Sequence[str] = CHANNEL,
) -> DataFrame:
    """Least and greatest allowed value per (plant, device, signal) channel of active signals.

    Channels that carry the attributes themselves need no join with the assets. ``bounds_valid`` is false where a rule has none of the known forms or names an attribute the
    device lacks.
    """
    pairs = [part for a in attributes for part in (F.lit(a), F.col(a).cast("double"))]
    if set(attributes) <= set(channels.columns):
        rated = channels.withColumn("_attrs", F.create_map(*pairs))
    else:
        attrs = assets.select(F.col("id").alias("asset_id"), F.create_map(*pairs).alias("_attrs"))
        rated = channels.select("asset_id", *keys).join(attrs, "asset_id")
    rules = dictionary.where("is_active").select("signal_key", "bound_min_rule", "bound_max_rule")
    low, low_ok = bound_value(F.col("bound_min_rule"), F.col("_attrs"))
    high, high_ok = bound_value(F.col("bound_max_rule"), F.col("_attrs"))
    return (
        rated.join(rules, "signal_key")
        .select(
            *keys,
            low.alias("bound_min"),
            high.alias("bound_max"),
            (low_ok & high_ok).alias("bounds_valid"),
        )
    )


def range_flag(value: Column) -> Column:
    """The range flag of a reading joined with its bounds, or null. Limits are inclusive."""
    return (
        F.when(~F.coalesce(F.col("bounds_valid"), F.lit(False)), F.lit(FLAG_NO_BOUNDS))
        .when(value > F.col("bound_max"), F.lit(FLAG_HIGH))
        .when(value < F.col("bound_min"), F.lit(FLAG_LOW))
    )


def qc_range(
    long: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str] = CHANNEL,
    value: str = "value",
    flags: str = "qc_flags",
) -> DataFrame:
    """Readings with the range flag in an array column; readings without bounds are flagged too.

    No hint: Spark broadcasts the bounds if they measure small, and otherwise sort-merges with
    adaptive splitting of a device that dominates.
    """
    on = list(keys)
    limits = bounds.select(*on, "bound_min", "bound_max", "bounds_valid")
    return long.join(limits, on, "left").select(
        *long.columns, F.array_compact(F.array(range_flag(F.col(value)))).alias(flags)
    )


def run_qc(
    readings: DataFrame,
    bounds: DataFrame,
    weather: DataFrame,
    plant: str = "plant",
    device: str = "device",
    ts: str = "ts",
    day: str = "local_date",
    arrival: str | None = None,
    daily_signal: str = DAILY_COUNTER,
    lifetime_signal: str = LIFETIME_COUNTER,
    irradiance: str = "irradiance",
    interval_s: int = 900,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Every rule on the long table: range, counter order, arrival order.

    One look-back per (plant, device, signal) serves both counter rules, which are chosen by the
    signal of the row; only the order of arrival takes a second one. Irradiance is looked up for
    falls of the daily counter within a day alone: other rows have no plant in that join, so they
    spread over its partitions by their slot and match nothing.
    """
    series = [plant, device, "signal_key"]
    signal, value = F.col("signal_key"), F.col("value")
    stepped = with_previous(readings, series, ["value", day], ts=ts, tie_breakers=tie_breakers, prefix="_prev_")
    fell = F.coalesce(value < F.col("_prev_value"), F.lit(False))
    drop = (signal == daily_signal) & fell & (F.col(day) == F.col(f"_prev_{day}"))
    stepped = stepped.withColumn("_drop", F.coalesce(drop, F.lit(False)))
    stepped = stepped.withColumn("_fell", F.when((signal == lifetime_signal) & fell, F.lit(FLAG_MONOTONIC)))
    if arrival is None:
        ordered = stepped.withColumn("_order", F.lit(None).cast("string"))
    else:
        ordered = qc_chronology(stepped, series, ts, arrival, basis=readings).withColumnRenamed("qc_flag", "_order")

    sun = irradiance_by_slot(weather, plant, ts, irradiance, interval_s).withColumnRenamed(plant, "_sun_plant")
    lit = ordered.withColumn("_sun_plant", F.when(F.col("_drop"), F.col(plant))).withColumn("_slot", slot(ts, interval_s))
    judged = lit.join(sun, ["_sun_plant", "_slot"], "left")
    limits = bounds.select(*series, "bound_min", "bound_max", "bounds_valid")
    dropped = F.when(F.col("_drop") & (F.col("_g") > 0), F.lit(FLAG_DAILY_DROP))
    return judged.join(limits, series, "left").select(
        *readings.columns,
        F.array_compact(F.array(range_flag(value), F.col("_fell"), dropped, F.col("_order"))).alias("qc_flags"),
        (F.col("_drop") & F.col("_g").isNull()).alias("daily_drop_unknown"),
    )


def qc_summary(
    flagged: DataFrame,
    keys: Sequence[str] = ("plant", "device", "local_date", "signal_key"),
    flags: str = "qc_flags",
) -> DataFrame:
    """Readings per flag for each plant, device, day and signal."""
    return (
        flagged.select(*keys, F.explode(flags).alias("qc_flag"))
        .groupBy(*keys, "qc_flag")
        .agg(F.count(F.lit(1)).alias("n_readings"))
    )


def availability(
    readings: DataFrame,
    weather: DataFrame,
    ratings: DataFrame,
    plant: str = "plant",
    device: str = "device",
    ts: str = "ts",
    ac: str = "ac_w",
    irradiance: str = "irradiance",
    rated: str = "rated_ac_w",
    interval_s: int = 900,
    daylight: float = DAYLIGHT_W_M2,
    down_share: float = DOWN_SHARE,
) -> DataFrame:
    """Share of daylight slots in which a device was not down, per device-day.

    ``unknown_slots`` counts readings that cannot be judged: no irradiance, no power, no rating.
    Readings are first brought to one row per device and slot, so the joins carry slots.
    """
    slots = (
        readings.select(
            plant, device, slot(ts, interval_s).alias("_slot"), F.col(ac).alias("_ac")
        )
        .groupBy(plant, device, "_slot")
        .agg(F.max("_ac").alias("_ac"))
    )
    sun = irradiance_by_slot(weather, plant, ts, irradiance, interval_s)
    judged = (
        slots.join(sun, [plant, "_slot"], "left")
        .join(ratings.select(plant, device, F.col(rated).alias("_rated")), [plant, device], "left")
        .withColumn("log_date", local_date("_slot"))
    )
    known = F.col("_g").isNotNull() & F.col("_ac").isNotNull() & F.col("_rated").isNotNull()
    bright = known & (F.col("_g") > daylight)
    down = bright & (F.col("_ac") < F.lit(down_share) * F.col("_rated"))
    return (
        judged.groupBy(plant, device, "log_date")
        .agg(
            count_where(bright).alias("daylight_slots"),
            count_where(down).alias("down_slots"),
            count_where(~known).alias("unknown_slots"),
        )
        .withColumn("availability", F.lit(1.0) - ratio("down_slots", "daylight_slots"))
    )
