"""Range routing of arriving readings, with counts of each micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from helioquant.operators.quality import CHANNEL, qc_range
from helioquant.sources.tables import ROUTE, ROUTE_METRICS, route_counts, with_route


def stream_qc(stream: DataFrame, bounds: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Range flags and the route of each arriving reading (the batch rule on a stream).

    The counts of both routes are observed in the pass that writes: ``micro_batch_counts``.
    """
    return with_route(qc_range(stream, bounds, keys)).observe(ROUTE_METRICS, *route_counts())


def micro_batch_counts(query: StreamingQuery) -> list[dict]:
    """batch, n_read, n_valid and n_dead_letter of the micro-batches that the query still reports."""
    found = []
    for progress in query.recentProgress:
        metrics = progress["observedMetrics"].get(ROUTE_METRICS)
        if metrics is not None:
            found.append({"batch": progress["batchId"], **{k: metrics[k] for k in ("n_read", "n_valid", "n_dead_letter")}})
    return found


def routed_writer(routed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of both sides of the split: one file sink, a folder per route.

    The sink's commit log makes the output exactly-once when executors or the driver are lost.
    """
    return (
        routed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(ROUTE)
        .outputMode("append")
    )
