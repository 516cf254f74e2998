"""Counter steps, resets and the order rules on counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where
from helioquant.functions.sequence import with_previous
from helioquant.functions.timestamps import slot

FLAG_MONOTONIC = "QC_MONOTONIC_INCREASING"
FLAG_DAILY_DROP = "QC_FLAG_DAILY_ENERGY_DROP"
FLAG_NOT_CHRONOLOGICAL = "QC_FLAG_NOT_CHRONOLOGICAL"

# Consecutive arrival numbers (of all devices) that make up one segment of the look-back.
ARRIVAL_UNIT = 100_000_000


def counter_step(
    df: DataFrame,
    counter: str = "total",
    keys: Sequence[str] = ("device",),
    ts: str = "ts",
    tie_breakers: Sequence[str] = (),
    name: str = "step",
) -> DataFrame:
    """Counter minus the device's previous value in time order; null on the first reading."""
    stepped = with_previous(
        df, keys, [counter], ts=ts, tie_breakers=tie_breakers, prefix="_prev_"
    )
    return stepped.withColumn(name, F.col(counter) - F.col(f"_prev_{counter}")).drop(
        f"_prev_{counter}"
    )


def counter_resets(stepped: DataFrame, step: str = "step") -> DataFrame:
    """Readings at which the counter fell."""
    return stepped.where(F.col(step) < 0)


def monotonic_verdict(
    stepped: DataFrame, by: Sequence[str] = ("plant",), step: str = "step"
) -> DataFrame:
    """Falls per plant and whether there are none."""
    falls = count_where(F.col(step) < 0)
    return stepped.groupBy(*by).agg(
        falls.alias("negative_steps"), (falls == 0).alias("is_monotonic")
    )


def counter_reset_samples(
    stepped: DataFrame,
    n: int = 8,
    keys: Sequence[str] = ("plant", "device"),
    ts: str = "ts",
    counter: str = "total",
) -> DataFrame:
    """The first ``n`` falls by device, time and counter (a top-n, not a full sort)."""
    falls = counter_resets(stepped).select(*keys, ts, counter, "step")
    return falls.orderBy(*keys, ts, counter, "step").limit(n)


def counter_range(df: DataFrame, counter: str = "total", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(counter).alias("min_counter"), F.max(counter).alias("max_counter")
    )


def qc_monotonic_total(
    df: DataFrame,
    counter: str = "total",
    keys: Sequence[str] = ("device",),
    ts: str = "ts",
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Flag lifetime-counter readings below the one before; equal readings pass."""
    stepped = counter_step(df, counter, keys, ts, tie_breakers, name="_step")
    return stepped.withColumn(
        "qc_flag", F.when(F.col("_step") < 0, F.lit(FLAG_MONOTONIC))
    ).drop("_step")


def irradiance_by_slot(
    weather: DataFrame,
    plant: str = "plant",
    ts: str = "ts",
    irradiance: str = "irradiance",
    interval_s: int = 900,
) -> DataFrame:
    """One irradiance per plant and slot (the largest, where several stations report)."""
    return (
        weather.where(F.col(irradiance).isNotNull())
        .select(plant, slot(ts, interval_s).alias("_slot"), F.col(irradiance).alias("_g"))
        .groupBy(plant, "_slot")
        .agg(F.max("_g").alias("_g"))
    )


def qc_daily_drop(
    readings: DataFrame,
    weather: DataFrame,
    counter: str = "daily",
    plant: str = "plant",
    device: str = "device",
    ts: str = "ts",
    day: str = "local_date",
    irradiance: str = "irradiance",
    interval_s: int = 900,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Whether the daily counter fell within a local day while the sun was up.

    ``daily_drop`` is true or false where that can be told, and null where the counter fell but
    no irradiance is known for the slot. A fall across midnight is the ordinary reset.
    """
    stepped = with_previous(
        readings,
        [plant, device],
        [counter, day],
        ts=ts,
        tie_breakers=tie_breakers,
        prefix="_prev_",
    )
    fell = F.coalesce(
        (F.col(counter) < F.col(f"_prev_{counter}")) & (F.col(day) == F.col(f"_prev_{day}")),
        F.lit(False),
    )
    sun = irradiance_by_slot(weather, plant, ts, irradiance, interval_s)
    joined = stepped.withColumn("_fell", fell).withColumn("_slot", slot(ts, interval_s)).join(
        sun, [plant, "_slot"], "left"
    )
    return joined.select(
        *readings.columns,
        F.when(~F.col("_fell"), F.lit(False)).otherwise(F.col("_g") > 0).alias("daily_drop"),
    ).withColumn("qc_flag", F.when(F.col("daily_drop"), F.lit(FLAG_DAILY_DROP)))


def qc_chronology(
    df: DataFrame,
    keys: Sequence[str] = ("device",),
    ts: str = "ts",
    arrival: str = "ingest_seq",
    basis: DataFrame | None = None,
) -> DataFrame:
    """Flag readings whose time does not lie after the device's previous arrival."""
    stepped = with_previous(
        df,
        keys,
        [ts],
        position=F.col(arrival).cast("long"),
        unit=ARRIVAL_UNIT,
        prefix="_prev_",
        basis=basis,
    )
    return stepped.withColumn(
        "qc_flag", F.when(F.col(ts) <= F.col(f"_prev_{ts}"), F.lit(FLAG_NOT_CHRONOLOGICAL))
    ).drop(f"_prev_{ts}")
