"""Table writers: dimensions, partitioned facts, and the valid/rejected split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where

ROUTE = "route"
VALID = "valid"
DEAD_LETTER = "dead_letter"
ROUTE_METRICS = "routes"
FACT_PARTITIONS = ("plant", "local_date")


def write_dim(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_dim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_facts(
    df: DataFrame, path: str, partitions=FACT_PARTITIONS, max_records_per_file: int = 5_000_000
) -> None:
    """Facts by plant and local date, so that readers prune folders.

    The hint keeps rows of one folder together and lets adaptive execution split folders that
    hold far more rows than the rest.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partitions)
        .parquet(path)
    )


def with_route(df: DataFrame, flags: str = "qc_flags") -> DataFrame:
    rejected = F.size(F.coalesce(F.col(flags), F.array())) > 0
    return df.withColumn(ROUTE, F.when(rejected, F.lit(DEAD_LETTER)).otherwise(F.lit(VALID)))


def route_readings(df: DataFrame, flags: str = "qc_flags") -> tuple[DataFrame, DataFrame]:
    """(valid, dead letter): readings without and with quality flags. No row is in both."""
    routed = with_route(df, flags)
    return (
        routed.where(F.col(ROUTE) == VALID).drop(ROUTE),
        routed.where(F.col(ROUTE) == DEAD_LETTER).drop(ROUTE),
    )


def route_counts() -> list[Column]:
    """Rows read, valid and rejected; the routed rows are counted while they are written."""
    return [
        F.count(F.lit(1)).alias("n_read"),
        count_where(F.col(ROUTE) == VALID).alias("n_valid"),
        count_where(F.col(ROUTE) == DEAD_LETTER).alias("n_dead_letter"),
    ]


def write_routed(df: DataFrame, path: str, flags: str = "qc_flags", mode: str = "overwrite") -> dict[str, int]:
    """Both sides of the split in one pass: a folder per route under ``path``. Returns its counts."""
    seen = Observation(ROUTE_METRICS)
    routed = with_route(df, flags).observe(seen, *route_counts())
    routed.write.mode(mode).partitionBy(ROUTE).parquet(path)
    return seen.get


def write_laid_out(
    df: DataFrame, table: str, keys: Sequence[str] = ("plant", "device"), order: Sequence[str] = ("ts",), buckets: int = 64, path: str | None = None
) -> None:
    """Facts as a table bucketed by ``keys`` and sorted by keys and ``order`` within a bucket.

    Joins, groupings and windows on the keys then need no exchange of the facts. Rows are dealt to
    the buckets before they are written, so that each bucket is one file. ``buckets`` belongs to the
    amount of data: a bucket is read by one task unless a join splits it.
    """
    writer = (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys, *order)
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)
