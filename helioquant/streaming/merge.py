"""Results of an update-mode stream, kept as the latest row of each key.

Each micro-batch writes the rows it changed into a folder of its own number. A batch that is run
again after a failure overwrites its folder, so that the merge of the folders is the same however
often batches are replayed. ``compact`` writes the merge so far as a base, and readers then skip the
batches before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter


def batch_writer(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of the changed rows of each micro-batch into ``path``/batches/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def _base(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """(number of its last batch, rows) of the newest base."""
    try:
        bases = spark.read.parquet(f"{path}/bases")
    except AnalysisException:  # none has been written
        return None
    upto = bases.agg(F.max("upto")).first()[0]
    return upto, bases.where(F.col("upto") == upto).withColumnRenamed("upto", "batch")


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The row of each key from the newest micro-batch that changed it."""
    rows = spark.read.parquet(f"{path}/batches")
    base = _base(spark, path)
    if base is not None:
        rows = rows.where(F.col("batch") > base[0]).unionByName(base[1])
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_row"))
    return merged.select(*keys, "_row.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Writes the merge of all batches so far as a base; returns the number of its last batch.

    A batch that is replayed afterwards must not be older than the base: call it between runs, or
    with batches that the checkpoint has committed.
    """
    upto = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    latest(spark, path, keys).write.mode("overwrite").parquet(f"{path}/bases/upto={upto}")
    return upto
