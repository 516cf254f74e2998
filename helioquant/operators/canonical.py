"""From wide raw readings to the canonical long table, and roll-ups of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import mean, total
from helioquant.functions.timestamps import slot
from helioquant.operators.dictionary import IRRADIANCE

READING_KEYS = ("plant", "device", "ts", "local_date")


def to_long(
    df: DataFrame, columns: Mapping[str, str], ids: Sequence[str] = READING_KEYS
) -> DataFrame:
    """Wide to long. ``columns`` maps a raw column of ``df`` to its source name.

    Rows are multiplied in place (no shuffle); nulls are kept, as a missing measure is a fact.
    """
    wide = df.select(*ids, *[F.col(c).cast("double").alias(n) for c, n in columns.items()])
    return wide.unpivot(list(ids), list(columns.values()), "source_name", "raw_value")


def canonicalize(
    long: DataFrame,
    channels: DataFrame,
    keys: Sequence[str] = ("device",),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Signal key, unit and scaled value from the channel table.

    ``channels`` has ``keys``, ``source_name``, ``signal_key``, ``target_unit`` and
    ``scale_factor``. No hint is given: Spark broadcasts the channels only if their measured
    size is small. A reading without a channel keeps a null signal and value. ``carry`` names
    further channel columns to attach, such as the aggregation method, to save a second join.
    """
    on = [*keys, "source_name"]
    return long.join(
        channels.select(*on, "signal_key", "scale_factor", "target_unit", *carry), on, "left"
    ).select(
        *long.columns,
        *carry,
        "signal_key",
        F.col("target_unit").alias("unit"),
        (F.col("raw_value") * F.col("scale_factor")).alias("value"),
    )


def rollup_channels(
    long: DataFrame,
    channels: DataFrame | None = None,
    interval_s: int = 3600,
    keys: Sequence[str] = ("device", "signal_key"),
    value: str = "value",
    ts: str = "ts",
    method: str = "aggregation_method",
    decimals: int | None = None,
) -> DataFrame:
    """Coarser readings by each channel's own method: avg, sum or last.

    All three are computed in one pass and the method picks one. Without
    ``channels`` the readings carry the method column themselves.
    """
    source = long
    if channels is not None:
        source = long.join(channels.select(*keys, method), list(keys), "left")
    grouped = (
        source.withColumn("slot_start", slot(ts, interval_s))
        .groupBy(*keys, method, "slot_start")
        .agg(
            F.count(value).alias("n_readings"),
            mean(value, decimals).alias("_avg"),
            total(value, decimals).alias("_sum"),
            # Of several readings at the last time the largest, whatever their order.
            F.max_by(value, F.struct(ts, value)).alias("_last"),
        )
    )
    picked = (
        F.when(F.col(method) == "avg", F.col("_avg"))
        .when(F.col(method) == "sum", F.col("_sum"))
        .when(F.col(method) == "last", F.col("_last"))
    )
    return grouped.select(*keys, method, "slot_start", "n_readings", picked.alias("value"))


def tag_irradiance(
    long: DataFrame, channels: DataFrame, keys: Sequence[str] = ("device", "signal_key")
) -> DataFrame:
    """Provenance flags of irradiance readings from their channel; false for other signals."""
    flags = channels.where(F.col("signal_key") == IRRADIANCE).select(
        *keys, F.col("approx_ghi").alias("_approx"), F.lit(True).alias("_poa")
    )
    return long.join(flags, list(keys), "left").select(
        *long.columns,
        F.coalesce("_approx", F.lit(False)).alias("approx_ghi"),
        F.coalesce("_poa", F.lit(False)).alias("poa_assumed"),
    )


def classify_columns(columns: DataFrame, mapping: DataFrame, name: str = "source_name") -> DataFrame:
    """Each raw column as a mapped signal, a dimension, or unmapped."""
    return columns.join(mapping, name, "left").select(
        *columns.columns,
        F.coalesce("role", F.lit("unmapped")).alias("role"),
        "target",
        "unit",
        "scale_factor",
    )
