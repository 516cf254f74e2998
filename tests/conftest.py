from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from helioquant.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "helioquant-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows and a schema; text in ``ts`` columns becomes a timestamp."""
    from pyspark.sql import functions as F

    def build(rows, schema):
        names = [part.strip().split(" ") for part in schema.split(",")]
        text = ", ".join(
            f"{n} string" if t in ("timestamp", "date") else f"{n} {t}" for n, t in names
        )
        df = spark.createDataFrame(rows, text)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in names])

    return build
