"""Energy by integration of power, and its reconciliation with hardware counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where, mean, ratio, round_half_up, total
from helioquant.functions.quantiles import grouped_percentiles
from helioquant.functions.timestamps import local_date

DEVICE_DAY = ("plant", "device", "log_date")


def integrated_energy(
    df: DataFrame,
    interval_h: float = 0.25,
    keys: Sequence[str] = ("plant", "device"),
    ac: str = "ac",
    ts: str = "ts",
    decimals: int | None = None,
) -> DataFrame:
    """Riemann sum of AC power per device-day: the authoritative energy figure."""
    return (
        df.withColumn("log_date", local_date(ts))
        .groupBy(*keys, "log_date")
        .agg((total(ac, decimals) * F.lit(interval_h)).alias("integrated_kwh"))
    )


def reconcile_energy(
    df: DataFrame,
    interval_h: float = 0.25,
    keys: Sequence[str] = ("plant", "device"),
    ac: str = "ac",
    daily: str = "daily",
    lifetime: str = "total",
    ts: str = "ts",
    decimals: int | None = None,
) -> DataFrame:
    """Integrated energy against the daily counter and the span of the lifetime counter.

    Device-days whose daily counter never rose above zero are left out. A zero integral gives a
    null ratio.
    """
    span = F.max(lifetime) - F.min(lifetime)
    return (
        df.withColumn("log_date", local_date(ts))
        .groupBy(*keys, "log_date")
        .agg(
            (total(ac, decimals) * F.lit(interval_h)).alias("integrated_kwh"),
            F.max(daily).alias("max_daily"),
            span.alias("total_span"),
        )
        .where(F.col("max_daily") > 0)
        .withColumn("ratio_daily_to_integrated", ratio("max_daily", "integrated_kwh"))
        .withColumn("span_vs_daily_diff", F.abs(F.col("total_span") - F.col("max_daily")))
    )


def reconciliation_summary(
    reconciled: DataFrame,
    by: Sequence[str] = ("plant",),
    decimals: int | None = None,
) -> DataFrame:
    """Mean, median and largest ratio and the mean counter disagreement, per plant."""
    r = "ratio_daily_to_integrated"
    table = grouped_percentiles(
        reconciled,
        list(by),
        {"median_ratio": (r, 0.5)},
        extra=[
            F.count(F.lit(1)).alias("device_days"),
            mean(r, decimals).alias("mean_ratio"),
            F.max(r).alias("max_ratio"),
            mean("span_vs_daily_diff", decimals).alias("mean_abs_diff"),
            count_where(F.col("integrated_kwh") == 0).alias("n_zero_integrated"),
        ],
    )
    return table.select(
        *by,
        "device_days",
        round_half_up("mean_ratio", 4).alias("mean_ratio"),
        round_half_up("median_ratio", 4).alias("median_ratio"),
        round_half_up("max_ratio", 4).alias("max_ratio"),
        round_half_up("mean_abs_diff", 2).alias("mean_abs_diff"),
        "n_zero_integrated",
    )


def plant_power(
    df: DataFrame,
    keys: Sequence[str] = ("plant", "ts"),
    ac: str = "ac",
    decimals: int | None = None,
) -> DataFrame:
    """Plant power as the sum over its devices at each time, with how many contributed."""
    return df.groupBy(*keys).agg(
        total(ac, decimals).alias("plant_ac"), F.count(ac).alias("contributing_devices")
    )
