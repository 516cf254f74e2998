"""Queries over stored sketches and over trees of any depth."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helioquant.operators import hierarchy, sketches
from helioquant.plans.adapters import generation, table
from helioquant.session import checkpoint_dir

QUANTILES = {"p50": ("ac", 0.50), "p95": ("ac", 0.95)}


def sketched_spans(spark, sf):
    """Two spans of days merged from stored feed-days, against exact counts of the same days.

    The days of the second half are written after the first, by a job that reads only them.
    """
    rows = generation(spark, sf)
    late = F.dayofmonth("local_date") > 15
    path = f"{checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    for half in (~late, late):
        sketches.write_days(sketches.daily_sketches(rows.where(half), ["ac"], by=("plant",)), path)
    spans = {"month": (None, None), "week": ("2024-01-12", "2024-01-18")}
    out = None
    for name, (first, last) in spans.items():
        merged = sketches.span_profile(sketches.read_days(spark, path, first, last), QUANTILES, by=("plant",))
        inside = rows if first is None else rows.where(F.col("local_date").between(F.lit(first), F.lit(last)))
        guess = merged.select("plant", "distinct_devices", "row_count", "calendar_days", *QUANTILES)
        # A quantile is right within the rank error if enough values lie at or below it and at or above it.
        ranks = [
            part
            for q in QUANTILES
            for part in (F.avg((F.col("ac") <= F.col(q)).cast("double")).alias(f"_le_{q}"),
                         F.avg((F.col("ac") >= F.col(q)).cast("double")).alias(f"_ge_{q}"))
        ]
        exact = inside.join(guess, "plant").groupBy("plant").agg(
            F.countDistinct("device").alias("_devices"),
            F.first("distinct_devices").alias("_guess"), F.first("row_count").alias("row_count"),
            F.first("calendar_days").alias("calendar_days"), *ranks,
        )
        near = F.abs(F.col("_guess") - F.col("_devices")) <= F.col("_devices") * sketches.device_error() + 1
        # Twice the 99 % bound, so that a run in which chance is unkind passes too.
        slack = 2 * sketches.rank_error()
        fine = [
            ((F.col(f"_le_{q}") >= p - slack) & (F.col(f"_ge_{q}") >= 1 - p - slack)).cast("string").alias(f"{q}_within")
            for q, (_, p) in QUANTILES.items()
        ]
        part = exact.select(F.lit(name).alias("span"), "plant", "row_count", "calendar_days", near.cast("string").alias("devices_within"), *fine)
        out = part if out is None else out.unionByName(part)
    return out


def trade_tree(spark, sf):
    """Regions, nations, customers and orders as a tree; suppliers in rings of three, some broken.

    A supplier's parent is the next one of its ring; the last ring may lack members, which makes
    it a plain chain. Parts hang below the suppliers of their number.
    """

    def node(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key))

    ring = F.col("s_suppkey") + F.when(F.col("s_suppkey") % 3 == 2, -2).otherwise(1)
    levels = [
        table(spark, sf, "region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")),
        table(spark, sf, "nation").select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent_id")),
        table(spark, sf, "customer").select(node("c", "c_custkey").alias("id"), node("n", "c_nationkey").alias("parent_id")),
        table(spark, sf, "orders").select(node("o", "o_orderkey").alias("id"), node("c", "o_custkey").alias("parent_id")),
        table(spark, sf, "supplier").select(node("s", "s_suppkey").alias("id"), F.concat(F.lit("s"), ring).alias("parent_id")),
        table(spark, sf, "part").select(node("p", "p_partkey").alias("id"), node("s", "p_partkey").alias("parent_id")),
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


TREE_SQL = """
tree AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION ALL SELECT 's' || s_suppkey, 's' || CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey - 2 ELSE s_suppkey + 1 END FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 's' || p_partkey FROM part),
down AS (
  SELECT id, id AS top, 0 AS depth FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree p WHERE p.id = t.parent_id)
  UNION ALL SELECT t.id, d.top, d.depth + 1 FROM tree t JOIN down d ON t.parent_id = d.id),
up AS (
  SELECT id AS origin, parent_id AS here, 1 AS steps FROM tree WHERE id LIKE 's%' AND id NOT IN (SELECT id FROM down)
  UNION ALL SELECT u.origin, t.parent_id, steps + 1 FROM up u JOIN tree t ON t.id = u.here WHERE u.here <> u.origin AND steps < 4),
rings AS (SELECT DISTINCT origin AS id FROM up WHERE here = origin)"""


def asset_ancestry(spark, sf):
    found = hierarchy.ancestry(trade_tree(spark, sf))
    return found.select(
        "id", F.coalesce("top", F.lit("")).alias("top"), F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.col("on_cycle").cast("string").alias("on_cycle"), F.col("below_cycle").cast("string").alias("below_cycle"),
    )


CUT = ("n3", "n7", "c11")


def subtree_delete(spark, sf):
    """What is left, by kind of node, once two nations and a customer go with all below them."""
    nodes = trade_tree(spark, sf)
    channels = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("asset_id"))
    kept, left = hierarchy.delete_subtrees(nodes, channels, CUT)
    return (
        kept.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))
        .unionByName(left.groupBy(F.lit("channel").alias("kind")).agg(F.count(F.lit(1)).alias("n_rows")))
    )


QUERIES = {
    "sketched_spans": (
        sketched_spans,
        """WITH e AS (SELECT event_type AS plant, CAST(ts AS DATE) AS d FROM events),
        s AS (SELECT 'month' AS span, plant, d FROM e
              UNION ALL SELECT 'week', plant, d FROM e WHERE d BETWEEN DATE '2024-01-12' AND DATE '2024-01-18')
        SELECT span, plant, count(*) AS row_count, date_diff('day', min(d), max(d)) + 1 AS calendar_days,
               'true' AS devices_within, 'true' AS p50_within, 'true' AS p95_within FROM s GROUP BY span, plant""",
    ),
    "asset_ancestry": (
        asset_ancestry,
        f"""WITH RECURSIVE {TREE_SQL}
        SELECT t.id, coalesce(d.top, '') AS top, coalesce(d.depth, -1) AS depth, CAST(r.id IS NOT NULL AS VARCHAR) AS on_cycle,
               CAST(d.id IS NULL AND r.id IS NULL AS VARCHAR) AS below_cycle
        FROM tree t LEFT JOIN down d USING (id) LEFT JOIN rings r USING (id)""",
    ),
    "subtree_delete": (
        subtree_delete,
        f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (3, 7) AND c_custkey <> 11),
        o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c) OR o_custkey NOT IN (SELECT c_custkey FROM customer))
        SELECT 'r' AS kind, count(*) AS n_rows FROM region UNION ALL SELECT 'n', count(*) FROM nation WHERE n_nationkey NOT IN (3, 7)
        UNION ALL SELECT 'c', count(*) FROM c UNION ALL SELECT 'o', count(*) FROM o
        UNION ALL SELECT 's', count(*) FROM supplier UNION ALL SELECT 'p', count(*) FROM part
        UNION ALL SELECT 'channel', count(*) FROM lineitem WHERE l_orderkey IN (FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    ),
}
