"""Previous-row lookup along a key's order, without one task per key.

A plain window over a key puts the key's whole history in one task, and one key may hold a large
share of all rows. Here a key's rows are cut along the order into segments (a day by default).
Rows look back inside their own segment; the last row of every segment is carried to the first
row of the key's next one. ``unit`` is the length of a segment on the axis: choose it so that the
rows of one key in one unit are a fair share of a task. The result is the same for any unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioquant.functions.timestamps import SECONDS_PER_DAY, epoch_micros

DAY_MICROS = SECONDS_PER_DAY * 1_000_000


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    ts: str | None = "ts",
    position: Column | None = None,
    unit: int = DAY_MICROS,
    tie_breakers: Sequence[str] = (),
    prefix: str = "prev_",
    basis: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev_<value>`` columns holding the values of the key's previous row.

    Order is ``ts`` (or the 64-bit ``position``), then ``tie_breakers``. The first row of a key
    gets nulls. So does a row with a null key or no position: it has no place in any order.

    Segment ends are read from ``basis``: a cheaper frame with the same rows
    (such as the scan that ``df`` was derived from), so that the work behind ``df`` is done once.
    """
    keys = list(keys)
    basis = df if basis is None else basis
    placed = position if position is not None else epoch_micros(ts)
    for key in keys:
        placed = F.when(F.col(key).isNotNull(), placed)

    def with_unit(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_pos", placed).withColumn(
            "_unit", F.expr(f"(_pos - pmod(_pos, {unit}L)) div {unit}L")
        )

    # Rows without a place in the order are spread by hash over segment numbers far below all others.
    hashable = [n for n, t in df.dtypes if not t.startswith(("map", "variant"))]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(1 << 60)) + F.lit(-(1 << 62))
    everything = with_unit(df).withColumn("_seg", F.coalesce("_unit", spread)).drop("_unit")

    row = F.struct(*[F.col(v) for v in values])
    order = ["_pos", *tie_breakers]
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    stepped = everything.withColumn("_prev", F.lag(row).over(inside))

    if tie_breakers:
        last = [F.max_by(row, F.struct(*order)).alias("_tail")]
        tail = F.col("_tail")
    else:
        # Primitive buffers keep this a hash aggregate.
        last = [F.max_by(v, "_pos").alias(f"_t_{v}") for v in values]
        tail = F.struct(*[F.col(f"_t_{v}").alias(v) for v in values])
    # One row per key and segment, however many readings a key has.
    in_order = with_unit(basis).where(F.col("_pos").isNotNull()).withColumnRenamed("_unit", "_seg")
    tails = in_order.groupBy(*keys, "_seg").agg(*last)
    carried = tails.select(
        *keys,
        "_seg",
        F.lag(tail).over(Window.partitionBy(*keys).orderBy("_seg")).alias("_carry"),
    ).where(F.col("_carry").isNotNull())

    # Same keys as the window above, so the large side is not shuffled again.
    joined = stepped.join(carried, [*keys, "_seg"], "left").withColumn(
        "_found", F.when(F.col("_pos").isNotNull(), F.coalesce("_prev", "_carry"))
    )
    return joined.select(
        *df.columns, *[F.col(f"_found.{v}").alias(f"{prefix}{v}") for v in values]
    )


# Consecutive sequence numbers that one group of ordered work spans at most.
CHUNK_ROWS = 1_000


def chunk_of(seq: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Which run of ``chunk_rows`` sequence numbers a row belongs to."""
    return F.floor(F.col(seq) / F.lit(chunk_rows))


def ordered_text(piece: str, order: str, separator: str = "") -> Column:
    """Concatenation of a group's non-null pieces in order."""
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"listagg(`{piece}`, '{quoted}') WITHIN GROUP (ORDER BY `{order}`)")
