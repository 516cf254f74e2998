"""Every registered query next to its SQL, and the shape of its plan."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from helioquant.plans.catalog import CATALOG
from oracle import connection, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: run for name, (run, _) in CATALOG.items()}
# These write files first, so that their plan is not the whole of their work.
STREAMS = {n for n in QUERIES if n.startswith("stream_")} | {"csv_feeds", "stored_facts", "text_feeds", "feed_clocks", "sketched_spans"}


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, duck.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        QUERIES[name](spark, SF_DIR).explain()
    plan = text.getvalue()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        if operator == "SinglePartition" and name in {"lowest_coverage", "counter_reset_samples", "raw_time_samples"}:
            continue  # a top-n
        assert operator not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
