"""Equi-joins that treat null keys as equal, keeping the left side's columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``<=>`` over ``keys``; Spark still plans it as a hash or sort-merge join."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = reduce(
        lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])
