"""Profiling of telemetry feeds: scope, coverage, outages, efficiency, capacity, yield."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.functions.fixed import fixed_rows
from helioquant.functions.joins import null_safe_join
from helioquant.functions.numeric import as_col, count_where, mean, ratio, round_half_up, scaled, total
from helioquant.functions.quantiles import grouped_percentiles
from helioquant.functions.timestamps import calendar_days, epoch_micros, local_date, slot

SLOTS_PER_DAY = 96

EFFICIENCY_QUANTILES = {
    "p05_eff": 0.05,
    "p25_eff": 0.25,
    "median_eff": 0.50,
    "p75_eff": 0.75,
    "p95_eff": 0.95,
}


def scope_profile(
    df: DataFrame, by: str = "feed", device: str = "device", ts: str = "ts", approx: bool = False
) -> DataFrame:
    """Rows, distinct devices, time range and calendar days per feed."""
    devices = F.approx_count_distinct(device) if approx else F.countDistinct(device)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("row_count"),
        devices.alias("distinct_devices"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        calendar_days(F.min(ts), F.max(ts)).alias("calendar_days"),
    )


def device_coverage(
    df: DataFrame,
    expected: int,
    keys: Sequence[str] = ("device",),
    top_n: int | None = None,
    distinct_slots: bool = False,
    ts: str = "ts",
    interval_s: int = 900,
) -> DataFrame:
    """Recorded and missing intervals per device, lowest coverage first.

    Rows are counted, as feeds report one row per interval; ``distinct_slots`` counts intervals
    instead, so that repeated rows do not raise the coverage.
    """
    keys = list(keys)
    if distinct_slots:
        # Two levels: repeats of a slot collapse map-side before anything is counted.
        slots = df.select(*keys, slot(ts, interval_s).alias("_slot")).distinct()
        counted = slots.where(F.col("_slot").isNotNull()).groupBy(*keys)
    else:
        counted = df.groupBy(*keys)
    out = counted.agg(F.count(F.lit(1)).alias("recorded_intervals")).select(
        *keys,
        "recorded_intervals",
        (F.lit(expected) - F.col("recorded_intervals")).alias("missing_intervals"),
        round_half_up(F.lit(100.0) * F.col("recorded_intervals") / F.lit(expected), 2).alias(
            "coverage_pct"
        ),
    )
    ordered = out.orderBy("recorded_intervals", *keys)
    return ordered if top_n is None else ordered.limit(top_n)


def clock_grid(
    df: DataFrame, keys: Sequence[str] = ("plant", "device"), ts: str = "ts", interval_s: int = 900
) -> DataFrame:
    """How a feed keeps to its interval: readings on and off the grid, repeated and missing slots.

    The grid is counted from midnight UTC of the epoch, as :func:`slot` does. A slot is missing if no reading
    lies in it although the device reported before and after. Readings without a time are counted
    apart. Readings collapse to slots where they lie, so what is shuffled is a row a slot.
    """
    over = F.pmod(epoch_micros(ts), F.lit(int(interval_s) * 1_000_000))
    slots = df.groupBy(*keys, slot(ts, interval_s).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), count_where(over == 0).alias("_on"), F.max(over).alias("_over")
    )
    timed = F.col("_slot").isNotNull()
    n_slots = F.count("_slot")
    span = F.max(epoch_micros("_slot")) - F.min(epoch_micros("_slot"))
    return slots.groupBy(*keys).agg(
        F.sum("_n").alias("n_readings"),
        F.coalesce(F.sum(F.when(~timed, F.col("_n"))), F.lit(0)).alias("n_without_time"),
        F.sum("_on").alias("n_on_grid"),
        F.coalesce(F.sum(F.when(timed, F.col("_n") - F.col("_on"))), F.lit(0)).alias("n_off_grid"),
        (F.max("_over") / F.lit(1e6)).alias("max_offset_s"),
        F.coalesce(F.sum(F.when(timed, F.col("_n") - 1)), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.floor(span / F.lit(int(interval_s) * 1_000_000)) + 1 - n_slots, F.lit(0)).alias("n_missing_slots"),
    )


def daily_counts(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Readings per device and calendar day."""
    return (
        df.withColumn("log_date", local_date(ts))
        .groupBy(*keys, "log_date")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def daily_interval_distribution(
    df: DataFrame,
    n_devices: int | None = None,
    n_days: int | None = None,
    per_day: int = SLOTS_PER_DAY,
    plant: str = "plant",
    device: str = "device",
    ts: str = "ts",
) -> DataFrame:
    """How many device-days are full, partial, over-full and missing, per plant.

    A plant's device-days are its devices times its days: the stated numbers, or those that reported
    at all. What is counted for them is one row a device-day.
    """
    devices = F.count_distinct(device) if n_devices is None else F.lit(n_devices)
    days = F.count_distinct("log_date") if n_days is None else F.lit(n_days)
    return (
        daily_counts(df, [plant, device], ts)
        .groupBy(plant)
        .agg(
            F.count(F.lit(1)).alias("total_device_days"),
            F.min("cnt").alias("min_intervals_day"),
            round_half_up(F.sum("cnt") / F.count(F.lit(1)), 2).alias("avg_intervals_day"),
            F.max("cnt").alias("max_intervals_day"),
            count_where(F.col("cnt") == per_day).alias("full_days"),
            count_where(F.col("cnt") < per_day).alias("partial_days"),
            count_where(F.col("cnt") > per_day).alias("over_full_days"),
            (devices * days - F.count(F.lit(1))).alias("missing_device_days"),
        )
    )


def missing_days(
    df: DataFrame,
    calendar: str = "observed",
    plant: str = "plant",
    device: str = "device",
    ts: str = "ts",
) -> DataFrame:
    """Days on which a device sent nothing, with their sorted list; devices with none are left out.

    The calendar of a plant is the set of days any of its devices reported (``observed``) or
    every day from its first to its last (``full``). A device's missing days are a set
    difference of two day arrays, so no device-by-day grid is built.
    """
    if calendar not in ("observed", "full"):
        raise ValueError(f"unknown calendar {calendar!r}")
    # Readings collapse to device-days map-side; what follows is days per device, not readings.
    device_days = (
        df.select(plant, device, local_date(ts).alias("_day"))
        .where(F.col("_day").isNotNull())
        .distinct()
    )
    reported = device_days.groupBy(plant, device).agg(F.collect_list("_day").alias("_reported"))
    if calendar == "observed":
        plant_days = (
            device_days.select(plant, "_day")
            .distinct()
            .groupBy(plant)
            .agg(F.sort_array(F.collect_list("_day")).alias("_calendar"))
        )
    else:
        plant_days = device_days.groupBy(plant).agg(
            F.sequence(F.min("_day"), F.max("_day")).alias("_calendar")
        )
    # The difference keeps the calendar's order, so it comes out sorted.
    missing = F.array_except("_calendar", "_reported")
    return (
        null_safe_join(reported, plant_days, [plant], "inner")
        .select(plant, device, missing.alias("_missing"))
        .where(F.size("_missing") > 0)
        .orderBy(F.desc(F.size("_missing")), plant, device)
        # The list is written after the sort, which would otherwise build it twice.
        .select(
            plant,
            device,
            F.size("_missing").alias("missing_days"),
            # A cast of the whole array (ISO dates) stays in generated code.
            F.array_join(F.col("_missing").cast("array<string>"), ", ").alias("missing_date_list"),
        )
    )


def efficiency(
    df: DataFrame,
    dc_min: float,
    ac_min: float,
    dc_scale: float = 1.0,
    dc: str = "dc",
    ac: str = "ac",
    name: str = "eff",
) -> DataFrame:
    """AC over scaled DC for readings above both floors (floors apply to the raw measures)."""
    return df.where((F.col(dc) > dc_min) & (F.col(ac) > ac_min)).withColumn(
        name, ratio(ac, scaled(dc, dc_scale))
    )


def efficiency_variants(
    df: DataFrame,
    dc_min: float,
    ac_min: float,
    dc_scales: Mapping[str, float],
    dc: str = "dc",
    ac: str = "ac",
    label: str = "label",
    name: str = "eff",
) -> DataFrame:
    """The same population under several DC factors, told apart by a label, from one scan."""
    scales = F.array(
        *[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("f")) for k, v in dc_scales.items()]
    )
    kept = df.where((F.col(dc) > dc_min) & (F.col(ac) > ac_min))
    return kept.select(F.col(dc).alias("_dc"), F.col(ac).alias("_ac"), F.explode(scales).alias("_s")).select(
        F.col("_s.label").alias(label), ratio("_ac", F.col("_dc") * F.col("_s.f")).alias(name)
    )


def labelled(frames: Mapping[str, DataFrame], column: str = "label") -> DataFrame:
    """Stack frames under a label column."""
    parts = [df.withColumn(column, F.lit(label)) for label, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def efficiency_profile(
    df: DataFrame,
    by: str = "label",
    eff: str = "eff",
    quantiles: Mapping[str, float] = EFFICIENCY_QUANTILES,
    digits: int = 4,
    approx: bool = False,
) -> DataFrame:
    """Smallest, largest and quantile efficiencies per label."""
    table = grouped_percentiles(
        df,
        [by],
        {name: (eff, p) for name, p in quantiles.items()},
        extra=[F.min(eff).alias("min_eff"), F.max(eff).alias("max_eff")],
        approx=approx,
    )
    names = ["min_eff", *quantiles, "max_eff"]
    return table.select(by, *[round_half_up(n, digits).alias(n) for n in names])


def irradiance_profile(
    weather: DataFrame,
    by: str = "station",
    value: str = "irradiation",
    digits: int = 4,
    approx: bool = False,
) -> DataFrame:
    """Range, medians (all readings, and readings above zero) and p99 per station."""
    table = grouped_percentiles(
        weather.select(
            by, value, F.when(F.col(value) > 0, F.col(value)).alias("_daylight")
        ),
        [by],
        {
            "median_all": (value, 0.50),
            "median_daylight": ("_daylight", 0.50),
            "p99_val": (value, 0.99),
        },
        extra=[F.min(value).alias("min_val"), F.max(value).alias("max_val")],
        approx=approx,
    )
    names = ["min_val", "median_all", "median_daylight", "p99_val", "max_val"]
    return table.select(by, *[round_half_up(n, digits).alias(n) for n in names])


def device_ratings(
    df: DataFrame,
    dc_scale: float = 1.0,
    keys: Sequence[str] = ("plant", "device"),
    dc: str = "dc",
    ac: str = "ac",
    prob: float = 0.99,
    approx: bool = False,
) -> DataFrame:
    """p99 and largest DC (scaled) and AC power per device."""
    rows = df.select(*keys, scaled(dc, dc_scale).alias("_dc"), F.col(ac).alias("_ac"))
    return grouped_percentiles(
        rows,
        list(keys),
        {"p99_dc": ("_dc", prob), "p99_ac": ("_ac", prob)},
        extra=[F.max("_dc").alias("max_dc"), F.max("_ac").alias("max_ac")],
        approx=approx,
    )


def rated_capacity(
    ratings: DataFrame, plant: str = "plant", decimals: int | None = None
) -> DataFrame:
    """Plant capacity from the p99 DC power of its devices (kWp and MWp)."""
    p99 = F.col("p99_dc")
    return ratings.groupBy(plant).agg(
        F.count(F.lit(1)).alias("num_devices"),
        round_half_up(F.min(p99), 2).alias("min_p99_dc_kwp"),
        round_half_up(mean(p99, decimals), 2).alias("avg_p99_dc_kwp"),
        round_half_up(F.max(p99), 2).alias("max_p99_dc_kwp"),
        round_half_up(total(p99, decimals), 2).alias("capacity_kwp"),
        round_half_up(total(p99, decimals) / F.lit(1000.0), 3).alias("capacity_mwp"),
    )


def scenario_table(
    spark: SparkSession, scenarios: Iterable[tuple[str, str, float]]
) -> DataFrame:
    """(plant, scenario, capacity in kWp) rows as a frame."""
    return fixed_rows(
        spark, list(scenarios), "plant string, scenario string, capacity_kwp double"
    )


def specific_yield(
    df: DataFrame,
    scenarios: DataFrame,
    interval_h: float = 0.25,
    plant: str = "plant",
    ac: str = "ac",
    ts: str = "ts",
    decimals: int | None = None,
    digits: int = 3,
) -> DataFrame:
    """Least, mean and greatest daily energy of a plant, and the same per kWp, per scenario.

    A scenario is a capacity assumed for a plant; a plant may have several. The daily energies
    are summed up once, whatever the number of scenarios. A plant without a scenario keeps its
    energies, with a null scenario and no yield.
    """
    daily = (
        df.select(plant, local_date(ts).alias("_day"), F.col(ac).alias("_ac"))
        .groupBy(plant, "_day")
        .agg((total("_ac", decimals) * F.lit(interval_h)).alias("_kwh"))
    )
    per_plant = daily.groupBy(plant).agg(
        F.min("_kwh").alias("_min"), mean("_kwh", decimals).alias("_avg"), F.max("_kwh").alias("_max")
    )
    kinds = ("min", "avg", "max")
    return per_plant.join(scenarios, plant, "left").select(
        "scenario",
        plant,
        *[round_half_up(f"_{k}", 0).alias(f"{k}_daily_kwh") for k in kinds],
        *[
            round_half_up(ratio(f"_{k}", "capacity_kwp"), digits).alias(f"{k}_specific_yield")
            for k in kinds
        ],
    )


def station_granularity(
    weather: DataFrame, plant: str = "plant", device: str = "device", ts: str = "ts"
) -> DataFrame:
    """Readings, first and last time per weather station, on parsed times."""
    return weather.groupBy(plant, device).agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
    )


def scaling_artifact(
    df: DataFrame,
    by: str = "plant",
    eff: str = "eff",
    band: tuple[float, float] = (0.95, 0.99),
    typical: float = 0.975,
    approx: bool = False,
) -> DataFrame:
    """Share of efficiencies inside the plausible band and the power of ten that would fix DC.

    A median near 0.0975 means DC is ten times too large: exponent -1, factor 0.1.
    """
    low, high = band
    table = grouped_percentiles(
        df,
        [by],
        {"median_eff": (eff, 0.5)},
        extra=[
            F.count(eff).alias("readings"),
            count_where(F.col(eff).between(low, high)).alias("in_band"),
        ],
        approx=approx,
    )
    exponent = F.when(
        ~F.col("median_eff").between(low, high) & (F.col("median_eff") > 0),
        F.floor(F.log10(F.col("median_eff") / F.lit(typical)) + F.lit(0.5)),
    ).otherwise(F.lit(0))
    return table.select(
        by,
        "readings",
        round_half_up("median_eff", 4).alias("median_eff"),
        round_half_up(ratio("in_band", "readings"), 4).alias("in_band_share"),
        exponent.cast("int").alias("dc_scale_exponent"),
    )


def metric_rows(df: DataFrame, plant: str = "plant", metrics: Sequence[str] | None = None) -> DataFrame:
    """A one-row-per-plant table turned into (plant, metric, value) rows."""
    names = list(metrics) if metrics is not None else [c for c in df.columns if c != plant]
    wide = df.select(F.col(plant).alias("plant"), *[as_col(n).cast("double").alias(n) for n in names])
    return wide.unpivot("plant", names, "metric", "value")


def plant_matrix(metrics: DataFrame, plants: Sequence[str]) -> DataFrame:
    """Metric by plant. The plants are named by the caller, so no extra job lists them."""
    return metrics.groupBy("metric").pivot("plant", list(plants)).agg(F.max("value"))
