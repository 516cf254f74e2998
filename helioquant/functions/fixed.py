"""Small fixed tables whose size Spark knows while it plans."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def fixed_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows as a local relation.

    Its exact size is part of the plan, so a join broadcasts it by Spark's own size check and
    needs no hint.
    """
    names = [part.split()[0] for part in schema.split(",")]
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema=schema)
