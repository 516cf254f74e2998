"""Trees of any depth kept as an adjacency table: tops, depths, cycles, subtrees.

Every node holds a pointer that reaches twice as far in each round, so a tree of depth d takes
about log2(d) joins of the nodes with themselves. What a round has found is checkpointed, as the
next one uses it more than once; this is the one place among the table operators where work runs at once.

Most nodes of a tree point to few targets once they reach far, and settled ones to none. So nodes are
dealt out by their target only where it has at most ``HEAVY`` of them; the facts of the other targets, one
for every ``HEAVY`` nodes at most, are sent to the nodes, and settled nodes are left where they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioquant.functions.numeric import count_where
from helioquant.session import checkpoint_dir

#: Nodes that are dealt to one task for their common target, at most.
HEAVY = 20_000


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def _looked_up(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """rows with the facts of their key (one row a key); null where the key is null or has none."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    found = sizes.join(facts, key, "left")
    met = rows.join(F.broadcast(found.where(F.col("_rows") > HEAVY)), key, "left")
    names = [*rows.columns, *[c for c in facts.columns if c != key]]
    settled = F.col("_rows").isNotNull() | F.col(key).isNull()
    others = met.where(~settled).select(*rows.columns).join(found.where(F.col("_rows") <= HEAVY), key)
    out = met.where(settled).select(*names).unionByName(others.select(*names))
    # The union of a round has the partitions of both sides; they must not add up over the rounds.
    return out.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _links(nodes: DataFrame, id: str, parent: str, marked: Column) -> DataFrame:
    """One row a node: its parent if that is a node too, else null."""
    own = nodes.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.min(parent).alias("_parent"), F.max(F.coalesce(marked, F.lit(False))).alias("_marked")
    )
    own = _cut(own)
    known = own.select(F.col("id").alias("_parent"), F.lit(True).alias("_known"))
    return _looked_up(own, "_parent", known).select(
        "id",
        F.when(F.col("_known"), F.col("_parent")).alias("_next"),
        F.when(F.col("_known"), F.col("_parent")).otherwise(F.col("id")).alias("top"),
        F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
        "_marked",
    )


def _doubled(state: DataFrame) -> DataFrame:
    """Each pointer replaced by its target's pointer; marks and depths of the stretch are added."""
    ahead = state.select(
        F.col("id").alias("_next"),
        F.col("_next").alias("_far"),
        F.col("top").alias("_top"),
        F.col("depth").alias("_depth"),
        F.col("_marked").alias("_above"),
    )
    return _looked_up(state, "_next", ahead).select(
        "id",
        F.col("_far").alias("_next"),
        F.coalesce("_top", "top").alias("top"),
        (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        (F.col("_marked") | F.coalesce("_above", F.lit(False))).alias("_marked"),
    )


def ancestry(
    nodes: DataFrame, id: str = "id", parent: str = "parent_id", marked: Column | None = None
) -> DataFrame:
    """Per node: ``top`` (its highest ancestor), ``depth``, ``on_cycle``, ``below_cycle``, ``marked``.

    ``marked`` is true for a node that fulfils the condition and for all nodes below one. A node on
    a cycle, or below one, has neither top nor depth. A parent that is not a node counts as none;
    rows without an id are left out; of several rows of an id the smallest parent counts, and any
    mark. Works for any depth: rounds end once a round neither settles a node nor leaves fewer
    pointer targets, which is when all that is left runs in cycles.
    """
    state = _cut(_links(nodes, id, parent, F.lit(False) if marked is None else marked))
    seen = None
    while True:
        # Two numbers come to the driver, whatever the number of nodes.
        now = state.where(F.col("_next").isNotNull()).groupBy("_next").agg(F.count(F.lit(1)).alias("n"))
        now = tuple(now.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
        if now[0] == 0 or now == seen:
            break
        seen = now
        state = _cut(_doubled(state))
    looping = F.col("_next").isNotNull()
    # After the last round the targets of the open pointers are the nodes of the cycles.
    cycles = state.where(looping).select(F.col("_next").alias("id"), F.lit(True).alias("_cycle")).distinct()
    on_cycle = F.coalesce("_cycle", F.lit(False))
    return state.join(cycles, "id", "left").select(
        "id",
        F.when(~looping, F.col("top")).alias("top"),
        F.when(~looping, F.col("depth")).alias("depth"),
        on_cycle.alias("on_cycle"),
        (looping & ~on_cycle).alias("below_cycle"),
        F.col("_marked").alias("marked"),
    )


def tree_summary(found: DataFrame) -> DataFrame:
    """Nodes and greatest depth per top, from :func:`ancestry`; nodes of cycles have a null top."""
    return found.groupBy("top").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.max("depth").alias("max_depth"),
        count_where(F.col("on_cycle")).alias("n_on_cycle"),
        count_where(F.col("below_cycle")).alias("n_below_cycle"),
    )


def delete_subtrees(
    assets: DataFrame, channels: DataFrame, asset_ids: Iterable[str]
) -> tuple[DataFrame, DataFrame]:
    """Remove assets with all that hangs below them, to any depth, and the channels of all these.

    On a cycle all nodes go if one does. Rows without an id stay.
    """
    found = ancestry(assets, marked=F.col("id").isin(*asset_ids))
    gone = found.where(F.col("marked")).select("id")
    return (
        assets.join(gone, "id", "left_anti"),
        channels.join(gone.withColumnRenamed("id", "asset_id"), "asset_id", "left_anti"),
    )


def cycle_violations(nodes: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes that are their own ancestors, in the form of the registry's violation rows."""
    return ancestry(nodes, id, parent).where(F.col("on_cycle")).select(
        F.lit("asset_tree_acyclic").alias("constraint"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n_rows")
    )
