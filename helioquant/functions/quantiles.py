"""Exact interpolated quantiles per group that hold when one group owns most of the rows.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here all groups, small or
large, take the same way:

1. a mergeable sketch of each group gives cut points close below and above each wanted rank,
2. one pass counts the rows between cut points; running totals tell in which bucket a rank lies,
3. only the buckets that hold a wanted rank are counted value by value, and running counts over
   that small table pick the values at the two ranks around the target.

A bucket around a rank holds about ``4 / accuracy`` of its group. A sketch that misses a rank makes
another bucket be counted, so the result is exact whatever the sketch says. A group of at most
``LARGE_GROUP`` values is one bucket. There is at most one larger group for every ``LARGE_GROUP`` values, so
the cut points and buckets of those are sent to the values, which stay where they are: dealt out by
group, all values of a group would be sorted by one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioquant.functions.joins import null_safe_join

ACCURACY = 100_000
#: Values of a group that are counted as one bucket, at most.
LARGE_GROUP = 100_000


def _probabilities(specs: Mapping[str, tuple[str, float]]) -> dict[str, list[float]]:
    by_column: dict[str, list[float]] = {}
    for column, prob in specs.values():
        if not 0.0 <= prob <= 1.0:
            raise ValueError(f"probability {prob} is outside [0, 1]")
        probs = by_column.setdefault(column, [])
        if prob not in probs:
            probs.append(prob)
    return {column: sorted(probs) for column, probs in by_column.items()}


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple[str, float]],
    extra: Sequence[Column] = (),
    approx: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Quantiles (and the aliased aggregates in ``extra``) per group.

    ``specs`` maps an output name to (value column, probability). ``approx=True`` uses the
    sketch alone.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("quantiles need at least one grouping column")
    by_column = _probabilities(specs)

    if approx:
        parts = [
            F.percentile_approx(c, probs, accuracy).alias(f"_q_{i}")
            for i, (c, probs) in enumerate(by_column.items())
        ]
        return _name_quantiles(df.groupBy(*keys).agg(*extra, *parts), by_column, specs)

    margin = 2.0 / accuracy
    probs = sorted({p for ps in by_column.values() for p in ps})
    around = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    columns = list(by_column)
    # One scan: the caller's aggregates, row counts and cut points of every value column.
    first = df.groupBy(*keys).agg(
        *extra,
        *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(F.col(c).cast("double"), around, accuracy).alias(f"_c_{i}") for i, c in enumerate(columns)],
    )
    cuts = _long(first, keys, [(F.col(f"_n_{i}").alias("_n"), F.col(f"_c_{i}").alias("_cuts")) for i in range(len(columns))])
    values = _long(df, keys, [(F.col(c).cast("double").alias("_v"),) for c in columns]).where(F.col("_v").isNotNull())
    groups = [*keys, "_series"]
    bucket = F.lit(0)
    for i in range(len(around)):
        bucket = bucket + F.when(F.get("_cuts", F.lit(i)) < F.col("_v"), 1).otherwise(0)
    large = F.broadcast(cuts.where(F.col("_n") > LARGE_GROUP))
    placed = null_safe_join(values, large, groups, "left").select(*groups, "_n", "_v", bucket.alias("_bucket"))
    ranks = _ranks(placed, groups, probs)
    names = [c for c in first.columns if not c.startswith(("_n_", "_c_"))]
    outputs = [
        F.max(F.when(F.col("_series") == F.lit(columns.index(c)), F.col(f"_p{probs.index(p)}"))).alias(name)
        for name, (c, p) in specs.items()
    ]
    return null_safe_join(first.select(*names), ranks.groupBy(*keys).agg(*outputs), keys, "left")


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[tuple[Column, ...]]) -> DataFrame:
    """A row for each row of df and value column, numbered by _series."""
    series = [F.struct(F.lit(i).alias("_series"), *parts) for i, parts in enumerate(columns)]
    return df.select(*keys, F.explode(F.array(*series)).alias("_e")).select(*keys, "_e.*")


def _ranks(placed: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The quantiles _p0, _p1, ... of each group; placed: groups, _n (null: a small group), _v and the _bucket of a value."""
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.where(F.col("_n").isNotNull()).groupBy(*groups, "_n", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))  # few rows a group

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("_n") - F.lit(1))

    wanted = [r(position(p)) for p in probs for r in (F.floor, F.ceil)]
    hit = F.lit(False)
    for rank in wanted:
        hit = hit | ((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c")))
    hits = buckets.where(hit).select(*groups, "_bucket", "_start")
    inside = null_safe_join(placed, F.broadcast(hits), [*groups, "_bucket"], "left")
    inside = inside.where(F.col("_n").isNull() | F.col("_start").isNotNull())
    counted = inside.groupBy(*groups, "_n", "_bucket", "_start", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*groups, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("_end", F.coalesce("_start", F.lit(0)) + F.sum("_c").over(order))
    # A small group is counted as a whole, so its size is the sum of its counts.
    running = running.withColumn("_n", F.coalesce("_n", F.sum("_c").over(Window.partitionBy(*groups, "_bucket"))))
    picks = [
        F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v"))).alias(f"_{i}")
        for i, rank in enumerate(wanted)
    ]
    picked = running.groupBy(*groups, "_n").agg(*picks)

    def quantile(i: int, p: float) -> Column:
        low, high = F.floor(position(p)), F.ceil(position(p))
        lo, hi = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        return F.when(low == high, lo).otherwise((high - position(p)) * lo + (position(p) - low) * hi)

    return picked.select(*groups, *[quantile(i, p).alias(f"_p{i}") for i, p in enumerate(probs)])


def _name_quantiles(df: DataFrame, by_column, specs) -> DataFrame:
    index = {c: i for i, c in enumerate(by_column)}
    out = df
    for name, (column, prob) in specs.items():
        position = by_column[column].index(prob)
        out = out.withColumn(name, F.get(F.col(f"_q_{index[column]}"), F.lit(position)))
    return out.drop(*[f"_q_{i}" for i in index.values()])
