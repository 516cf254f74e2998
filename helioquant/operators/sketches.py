"""Profiles over any span of days from stored, mergeable sketches.

A feed-day is one row: counts, time range, a HyperLogLog sketch of its devices and a KLL sketch of
each measure. Days are written apart, so a new day reads no old reading, and a span is the merge of
its days' rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioquant.functions.timestamps import calendar_days, local_date

LG_CONFIG_K = 14
KLL_K = 800
DAY = "log_date"


def device_error(lg_k: int = LG_CONFIG_K) -> float:
    """Relative error of the device count that is exceeded once in some 400 estimates (3 sigma)."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """Rank error of a quantile, as a share of the readings, at 99 % confidence."""
    return 2.296 / k**0.9723


def daily_sketches(
    readings: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = ("feed",),
    device: str = "device",
    ts: str = "ts",
    lg_k: int = LG_CONFIG_K,
    k: int = KLL_K,
) -> DataFrame:
    """One row per feed and local day (null: readings without a time). Nulls enter no sketch.

    Sketches are built where the readings lie; only they are shuffled, also for a feed that holds
    most rows.
    """
    return readings.groupBy(*by, local_date(ts).alias(DAY)).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        F.hll_sketch_agg(F.col(device).cast("string"), lg_k).alias("devices"),
        *[F.kll_sketch_agg_double(F.col(v).cast("double"), k).alias(f"kll_{v}") for v in values],
    )


def write_days(sketches: DataFrame, path: str) -> None:
    """Write feed-days by date; a day written again replaces itself and touches no other day."""
    (
        sketches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored feed-days from ``first`` to ``last`` (ISO dates, inclusive); other folders are not read."""
    days = spark.read.parquet(path)
    if first is not None:
        days = days.where(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        days = days.where(F.col(DAY) <= F.lit(last).cast("date"))
    return days


def span_profile(
    days: DataFrame,
    quantiles: Mapping[str, tuple[str, float]] | None = None,
    by: Sequence[str] = ("feed",),
) -> DataFrame:
    """Rows, estimated devices, time range, calendar days and estimated quantiles of the days given.

    ``quantiles`` maps an output name to (measure, probability); a measure without values gives null.
    """
    quantiles = quantiles or {}
    values = list(dict.fromkeys(value for value, _ in quantiles.values()))
    merged = days.groupBy(*by).agg(
        F.sum("row_count").alias("row_count"),
        F.hll_sketch_estimate(F.hll_union_agg("devices")).alias("distinct_devices"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        *[F.kll_merge_agg_double(f"kll_{v}").alias(f"_kll_{v}") for v in values],
    )

    def quantile(value: str, probability: float):
        sketch = F.col(f"_kll_{value}")
        filled = F.kll_sketch_get_n_double(sketch) > 0
        return F.when(filled, F.kll_sketch_get_quantile_double(sketch, F.lit(probability)))

    return merged.select(
        *by, "row_count", "distinct_devices", "min_ts", "max_ts",
        calendar_days("min_ts", "max_ts").alias("calendar_days"),
        *[quantile(*spec).alias(name) for name, spec in quantiles.items()],
    )
