"""Benchmark windows in documents against a plain search."""

from __future__ import annotations

import hashlib
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helioquant.llm import decontamination
from helioquant.llm.catalog import CATALOG

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connection, difference  # noqa: E402


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    """Per row of docs: id, words, merged spans, ids of the items."""
    cuts = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            cuts.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(c) for c in cuts}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in cuts:
                    hit.update(range(i, i + n))
                    found.update(str(x) for x in cuts[tuple(w[i : i + n])] if x is not None)
        out.append((doc_id, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_words, sum(e - s for s, e in r.spans), ",".join(r.items)) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def items(prose):
    base = prose(1, 120).split()
    return [
        (3, " ".join(base[20:45])), (20, " ".join(base[30:60]).upper()), (100, " ".join(base[20:45])),
        (7, "漢字 🙂 éa"), (8, "one TWO"), (9, "a"), (11, None), (12, " .,- "), (12, prose(2, 6000)[2000:2400]),
        (None, " ".join(base[80:95])), (13, prose(77, 40)), (14, "ba ko mi ten ru sal"), (15, "changed"),
    ]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return frame.withColumns({c: F.lit("x") for c in ("item", "words", "size", "window", "token", "bits", "doc_id")})


def test_hard_rows_equal_a_plain_search(hard, hard_rows, benchmark, items):
    docs = hard.withColumns({c: F.lit("x") for c in ("row", "runs", "n_words", "spans", "items", "start", "window")})
    result = decontamination.contaminated_spans(docs, benchmark)
    want = plain([r[:2] for r in hard_rows], items)
    assert got(result) == want
    assert sum(1 for w in want if w[2]) > 5 and any("100,20,3" in w[3] for w in want)


@pytest.mark.parametrize("window", [3, 5, 10, 30])
def test_other_windows(hard, hard_rows, benchmark, items, window):
    assert got(decontamination.contaminated_spans(hard, benchmark, window=window)) == plain([r[:2] for r in hard_rows], items, window)


def test_full_bitmap_only_costs_time(monkeypatch, hard, hard_rows, benchmark, items):
    monkeypatch.setattr(decontamination, "bitmap_of", lambda bits: b"\xff" * (decontamination.BITMAP_BITS // 8))
    some = hard.where("doc_id <> 7 or doc_id is null")
    assert got(decontamination.contaminated_spans(some, benchmark)) == plain([r[:2] for r in hard_rows if r[0] != 7], items)


def test_long_texts_in_stretches(monkeypatch, hard, hard_rows, benchmark, items):
    monkeypatch.setattr(decontamination, "_STRETCH", 64)
    spans = [decontamination.word_spans(t) for t in (b"ab cd  ef" * 40, b"x" * 500, b"")]
    assert [len(s[0]) for s in spans] == [81, 1, 0]
    assert len(words("ab cd  ef" * 40)) == 81


def test_no_items_and_no_documents(hard, nothing, benchmark, hard_rows):
    assert decontamination.contaminated_spans(nothing, benchmark).count() == 0
    clean = decontamination.contaminated_spans(hard, benchmark.limit(0)).collect()
    assert len(clean) == len(hard_rows) and all(r.spans == [] and r["items"] == [] for r in clean)


def test_a_passage_in_a_third_of_the_documents(spark, prose):
    passage = prose(5, 30)
    rows = [(i, prose(100 + i, 30) + (" " + passage if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, passage), (2, prose(6, 30))]
    assert got(decontamination.contaminated_spans(docs, spark.createDataFrame(items, "item_id long, text string"))) == plain(rows, items)


def test_query_equals_sql(spark):
    run, sql = CATALOG["op13_benchmark_decontamination"]
    result = run(spark, "/root/testdata/sf0.001").toPandas()
    assert difference(result, connection("/root/testdata/sf0.001").execute(sql).df()) is None
    assert result.contaminated.any() and result.items_sha256.iloc[0] is not None
    assert hashlib.sha256(b"").hexdigest() in set(result.items_sha256)
