"""Device-day energy on a stream, open days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import total


def stream_daily_energy(
    stream: DataFrame,
    interval_h: float = 0.25,
    keys: Sequence[str] = ("plant", "device"),
    ac: str = "ac",
    ts: str = "ts",
    lateness: str = "1 hour",
    decimals: int | None = None,
    zone: str = "UTC",
) -> DataFrame:
    """Integrated energy per device and local day, for update mode.

    Every micro-batch gives the days it changed, also those still open; ``merge.batch_writer`` and
    ``merge.latest`` keep the newest row of each. A day's state is let go once the watermark, on
    the plant's clock, has passed it; readings that come later still are dropped and counted
    (``order.dropped_by_watermark``). Readings without a time belong to no day.
    """
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return (
        stream.withColumn("_local", local)
        .withWatermark("_local", lateness)
        .groupBy(*keys, F.window("_local", "1 day").alias("_day"))
        .agg(
            (total(ac, decimals) * F.lit(interval_h)).alias("integrated_kwh"),
            F.count(ac).alias("n_readings"),
        )
        .select(*keys, F.to_date("_day.start").alias("log_date"), "integrated_kwh", "n_readings")
    )
