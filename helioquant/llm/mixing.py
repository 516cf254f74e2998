"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 and 1 and shares are normalised
again. The exponent is the largest at which the entropy of the weights is at least ``entropy`` times
the largest possible, or, where that would repeat a source more than ``repeats`` times, the smallest
that keeps to this limit. The search cuts an interval at many points at a time, each round one
aggregation of the table of sources of which a row for each point reaches the driver.

The budget of a source is passed over its documents in epochs. Documents are dealt into blocks by a
hash; each epoch permutes the blocks, and the documents inside each, anew. Whole blocks are taken
while the budget lasts, and of the block where it ends the documents before the end, so that a
running sum never needs more than the table of blocks and one block at a time. The document at which
the budget ends is taken if more than half of it is inside. ``position`` is where a document stands in its
source's stream, from 0 to 1: sorting by it interleaves the sources at their weights throughout.

Tokens are counted as words between white space. Defined cases: null and empty texts have no tokens
and are taken in each whole epoch; null sources are one source of their own; a source without tokens
is taken once; repeated rows are documents of their own; no rows give no rows; other columns play no
part and pass through if they are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioquant.llm.common import cut_lineage, read_table, under_reserved_names

#: Target entropy as a share of the largest, passes of a source at most, tokens as a share of all.
ENTROPY, REPEATS, BUDGET = 0.98, 4.0, 1.0
#: Documents of a block, about; cut points of a round of the search, and rounds.
BLOCK, CUTS, ROUNDS = 1000, 64, 4


def word_count(text: Column) -> Column:
    """Words between white space; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_weights(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> DataFrame:
    """sources (source, tokens, documents) with weight, exponent and wanted, the tokens it may use."""
    sized = sources.where("tokens > 0")
    all_tokens, count = sized.agg(F.sum("tokens"), F.count("*")).first()
    if not count:
        return sources.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("exponent"), F.lit(0).cast("long").alias("wanted"))
    share = F.col("tokens") / all_tokens

    def good(points: list[float]) -> list[tuple[bool, bool]]:
        tried = sized.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("x")).withColumn("q", F.pow("p", "x"))
        sums = tried.groupBy("x").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("e"), F.max(F.col("q") / F.col("p")).alias("most"))
        by = {r.x: r for r in sums.collect()}
        rows = [by[x] for x in points]
        return [
            (math.log(r.z) - r.e / r.z >= entropy * math.log(count) - 1e-9, budget * r.most / r.z <= repeats + 1e-9) for r in rows
        ]

    def edge(which: int) -> float:
        """The last point at which the condition on the entropy (0) holds, or the first for the one on repeats (1)."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
            holds = [g[which] for g in good(points)]
            if which == 0:
                last = max((i for i, h in enumerate(holds) if h), default=0)
                low, high = points[last], points[min(last + 1, CUTS)]
            else:
                first = min((i for i, h in enumerate(holds) if h), default=CUTS)
                low, high = points[max(first - 1, 0)], points[first]
            if low == high:
                break
        return low if which == 0 else high

    low = edge(0)
    if not good([low])[0][1]:
        low = max(low, edge(1))
    power = F.pow(share, F.lit(low))
    total = sized.agg(F.sum(power)).first()[0]
    weight = F.when(F.col("tokens") > 0, power / total).otherwise(0.0)
    wanted = F.least(F.floor(weight * float(budget * all_tokens)), F.floor(F.col("tokens") * repeats)).cast("long")
    return sources.select("*", weight.alias("weight"), F.lit(low).alias("exponent"), wanted.alias("wanted"))


def mix(
    docs: DataFrame, keep: list[str], entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET,
    text: str = "text", source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """keep's columns of docs, each row as often as the mixture takes it, with tokens, weight, epoch (from 0) and position."""
    facts = [F.col(source).alias("s"), word_count(F.col(text)).alias("tokens"), F.xxhash64(F.col(key), F.col(text)).alias("tag")]
    light = cut_lineage(docs.select(*facts))
    sources = light.groupBy("s").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    sources = cut_lineage(source_weights(sources, entropy, repeats, budget)).select(
        F.col("s").alias("of"), "weight", F.col("tokens").alias("whole"), F.col("wanted"),
        F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(F.lit(0)).alias("passes"),
        F.ceil(F.col("documents") / BLOCK).alias("parts"),
    )

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(sources, F.col("s").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod("tag", "parts"))

    # The last pass is a part of one; a source without tokens is taken once.
    passes = F.when(F.col("whole") == 0, F.lit(0)).otherwise(F.when(F.col("passes") * F.col("whole") < F.col("wanted"), F.col("passes")).otherwise(F.col("passes") - 1))
    blocks = (
        placed(light).groupBy("s", "block", "whole", "wanted", passes.alias("last")).agg(F.sum("tokens").alias("size"))
        .where("last >= 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("epoch"))
    )
    order = Window.partitionBy("s", "epoch").orderBy(F.xxhash64("block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("epoch") * F.col("whole") + F.coalesce(F.sum("size").over(order), F.lit(0))
    blocks = blocks.withColumn("begin", begin).where((F.col("begin") < F.col("wanted")) | (F.col("whole") == 0))
    blocks = blocks.select(F.col("s").alias("of"), F.col("block").alias("at"), "epoch", "begin")

    rows = placed(docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), *facts))
    rows = rows.join(blocks, F.col("s").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    inside = Window.partitionBy("s", "block", "epoch").orderBy(F.xxhash64("tag", "epoch"), "tag").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    rows = rows.withColumn("start", start).where((F.col("start") + F.col("tokens") / 2 < F.col("wanted")) | (F.col("whole") == 0))
    position = F.when(F.col("wanted") > 0, F.col("start") / F.col("wanted")).otherwise(F.lit(0.0))
    return rows.select("row.*", "tokens", "weight", "epoch", position.alias("position"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the place of each in its source's stream."""
    return mix(read_table(spark, sf_dir, "documents"), ["doc_id", "source"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mixture takes it, repeats as rows of their own."""
    own, given = under_reserved_names(docs, ["doc_id", "text", "source"])
    return given(mix(own, own.columns))
