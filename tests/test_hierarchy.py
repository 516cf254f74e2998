from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helioquant.operators import hierarchy

SCHEMA = "id string, parent_id string"


def plain(rows):
    """Top, depth, cycle and below-cycle of each node by walking up."""
    parent = {}
    for node, up in sorted(rows, key=lambda r: (r[0] or "", r[1] is None, r[1] or "")):
        if node is not None:
            parent.setdefault(node, up)
    out = {}
    for node in parent:
        path, at = [node], node
        while parent[at] in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at] in parent:
            ring = path[path.index(parent[at]):]
            out[node] = (None, None, node in ring, node not in ring)
        else:
            out[node] = (at, len(path) - 1, False, False)
    return out


def found(df, **kw):
    return {r.id: (r.top, r.depth, r.on_cycle, r.below_cycle) for r in hierarchy.ancestry(df, **kw).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_forests_with_cycles(spark, seed):
    dice = random.Random(seed)
    rows = [(f"n{i}", dice.choice([None, "gone", *[f"n{dice.randrange(60)}"] * 8])) for i in range(60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_deep_chain_below_a_long_cycle(spark):
    rows = [(f"c{i}", f"c{(i + 1) % 37}") for i in range(37)]
    rows += [(f"t{i}", f"t{i - 1}" if i else "c5") for i in range(300)]
    rows += [(f"d{i}", f"d{i - 1}" if i else None) for i in range(500)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rows = [("a", None), ("a", None), ("b", "a"), ("b", "zz"), (None, "a"), ("own", "own"), ("lost", "nowhere")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"top": F.lit(1), "depth": F.lit(2), "_next": F.lit(3)})
    assert found(df) == {"a": ("a", 0, False, False), "b": ("a", 1, False, False), "own": (None, None, True, False), "lost": ("lost", 0, False, False)}
    assert found(df.limit(0)) == {}
    violations = hierarchy.cycle_violations(df).collect()
    assert [(r["constraint"], r.key, r.n_rows) for r in violations] == [("asset_tree_acyclic", "own", 1)]


def test_summary(spark):
    rows = [("r", None), ("x", "r"), ("y", "x"), ("p", "q"), ("q", "p"), ("u", "q")]
    out = {r.top: tuple(r)[1:] for r in hierarchy.tree_summary(hierarchy.ancestry(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out == {"r": (3, 2, 0, 0), None: (3, None, 2, 1)}


def test_subtrees_go_with_their_channels(spark):
    rows = [("block", None), ("inv", "block"), ("string", "inv"), ("panel", "string"), ("ws", "block"), ("c1", "c2"), ("c2", "c1"), (None, "inv")]
    assets = spark.createDataFrame(rows, SCHEMA)
    channels = spark.createDataFrame([("panel", 1), ("panel", 2), ("ws", 3), ("c2", 4), ("other", 5)], "asset_id string, n int")
    kept, left = hierarchy.delete_subtrees(assets, channels, ["inv", "c1"])
    assert {r.id for r in kept.collect()} == {"block", "ws", None}
    assert sorted(r.n for r in left.collect()) == [3, 5]


def test_heavy_and_settled_nodes_are_not_dealt_out_by_target(spark, frame, monkeypatch):
    monkeypatch.setattr(hierarchy, "HEAVY", 3)
    rows = [("top", None), ("ring", "gnir"), ("gnir", "ring")]
    rows += [(f"a{i}", "top" if i % 2 else "gone") for i in range(20)]
    rows += [(f"b{i}", f"a{i // 10}") for i in range(60)] + [(f"c{i}", f"b{i // 2}") for i in range(60)] + [("under", "ring")]
    df = frame(rows, SCHEMA)
    assert found(df) == plain(rows)

    # Whatever the nodes point to, a task gets a share of them: no task may hold most of them.
    state = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 1, F.lit("0")).when(F.col("id") % 400 == 2, F.lit("4")).alias("_next")
    ).repartition(4)
    facts = spark.range(10).select(F.col("id").cast("string").alias("_next"), (F.col("id") + 1).alias("fact"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        met = hierarchy._looked_up(state, "_next", facts)
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        kinds = {(r._next, r.fact): r["count"] for r in met.groupBy("_next", "fact").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kinds == {("0", 1): 1000, ("4", 5): 10, (None, None): 2990}
    assert max(sizes) <= 2000 and len(sizes) <= 4
