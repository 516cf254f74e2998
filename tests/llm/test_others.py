"""Licences, mixing, neighbours, toxicity, address filters, the pipeline and the catalogue."""

from __future__ import annotations

import datetime
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from helioquant.llm import licenses, mixing, neardup, neighbours, packing, repeats, toxicity, urlfilter
from helioquant.llm.catalog import CATALOG

SMALL = "/root/testdata/sf0.001"


# licences


def plain_scan(rows):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        every = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, notice in licenses.NOTICES.items():
            t = licenses.template_words(notice)
            wanted = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            size, step = licenses.window_size(len(t))
            found = [(s, len(wanted & set(every[s : s + size - 4])) / len(wanted)) for s in range(0, len(every), step)]
            found = [x for x in found if x[1] >= 0.8]
            if found:
                out[(doc_id, name)] = (len(found), found[0][0], max(c for _, c in found))
    return out


def test_licences_equal_plain_scan(spark, prose, nothing, hard):
    rows = [(0, None), (1, ""), (2, prose(1, 30)), (None, licenses.NOTICES["MIT"])]
    for i, notice in enumerate(licenses.NOTICES.values()):
        rows += [(10 + i, notice), (30 + i, prose(i, 37) + " " + notice.upper() + "\n" + prose(i, 200) + " " + notice)]
        rows.append((50 + i, prose(i, 9) + " ".join(notice.split()[:-2])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.n_windows, r.first_word, r.containment) for r in licenses.scan(df).collect()}
    assert got == plain_scan(rows[:3] + rows[4:])
    assert licenses.scan(nothing).count() == 0 and licenses.scan(hard).count() == 0
    with pytest.raises(ValueError):
        licenses.templates_frame(spark, {"x": "too short"})


# mixing


def test_mixture_meets_its_targets(spark, prose):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(5, 60)), "hot" if i % 3 else f"s{i % 11}") for i in range(1500)]
    rows += [(i, t, s) for i, t, s in [(2000, None, "hot"), (2001, "", None), (2002, "only words here", None)]] + [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, ["doc_id", "source"], entropy=0.95, repeats=8.0).toPandas()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    total, used = sum(sizes.values()), Counter()
    for r in got.itertuples():
        used[r.source] += r.tokens
    weights = {r.source: r.weight for r in got.itertuples()}
    spread = -sum(w * math.log(w) for w in weights.values()) / math.log(len(sizes))
    most = max(weights[s] * total / n for s, n in sizes.items())
    assert spread >= 0.95 - 1e-6 or most > 8 - 1e-3
    for s, n in sizes.items():
        wanted = min(int(weights[s] * total), 8 * n)
        assert abs(used[s] - wanted) <= 60
    # A pass takes a row once; equal rows are rows of their own.
    passes = Counter((r.doc_id, r.epoch) for r in got.itertuples())
    assert max(n for (i, _), n in passes.items() if i != 0) == 1 and got.position.between(0, 1).all()
    full = got[(got.source == "s5") & (got.epoch == 0)]
    if got[got.source == "s5"].epoch.max() > 0:
        assert set(full.doc_id) == {i for i, _, s in rows if s == "s5"}


def test_mixture_of_hard_rows(hard, nothing):
    got = mixing.mix(hard, hard.columns)
    assert {"doc_id", "lang", "epoch", "position"} <= set(got.columns) and got.count() > 0
    assert mixing.mix(nothing, ["doc_id"]).count() == 0


# neighbours


def test_neighbours_of_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [0.0, 2.0]), (7, [1.0]), (None, [1.0, 1.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 6), (1, 1, 0), (1, 2, 6), (6, 1, 0), (6, 2, 1)]
    assert got[1].score == math.sqrt(5)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:900] = x[7]  # a very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), shard=700).toPandas()
    found = 0
    for i, own in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], atol=1e-12)
        found += len(set(own.vec_id) & set(best))
    assert got.query_id.nunique() == 60 and found / 600 >= 0.95


# toxicity


def test_toxicity_learns_marked_words(spark, prose):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text = prose(i, rng.randint(30, 90)).split()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["nastyword", "vileterm", "grubling"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "nastyword vileterm " * 20)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:300], (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    wrong = sum(got[i].predicted != y for i, y in labels[300:])
    assert wrong <= 3 and got[None].predicted == 1 and got[900].predicted == got[901].predicted == 0
    empty = toxicity.learn_toxicity(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, empty, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = got[got.held_out].merge(marks, on="doc_id")
    assert both.predicted[both.toxic == 1].mean() > 0.8 and both.predicted[both.toxic == 0].mean() < 0.02


# address filters


def day(text):
    return datetime.date.fromisoformat(text)


def test_captures_meet_the_entries_of_their_day(spark):
    entries = spark.createDataFrame(
        [("host", "a.example.org", day("2024-01-10"), True), ("host", "a.example.org", day("2024-03-05"), False),
         ("host", "a.example.org", day("2024-03-05"), True), ("domain", "example.org", day("2024-02-01"), True),
         ("prefix", "a.example.org/x", day("2024-02-10"), True), ("host", None, day("2024-01-01"), True), ("url", "b.c/d", None, True)],
        "kind string, key string, listed date, added boolean",
    )
    captures = [
        (1, "http://A.example.org/x/1?q", day("2024-01-09")), (2, "http://A.example.org/x/1?q", day("2024-01-10")),
        (3, "https://u@a.example.org:8/x/1#f", day("2024-03-04")), (4, "http://a.example.org/y", day("2024-03-05")),
        (5, None, day("2024-03-05")), (6, "http://a.example.org/x", None), (7, "not an address", day("2024-03-05")), (None, "http://b.c/d", day("2024-03-05")),
    ]
    df = spark.createDataFrame([*captures, captures[1]], "id long, url string, fetched date").selectExpr("*", "1 AS blocked")
    got = {r.id: (r.blocked, r.n_active, r.rule_kind, r.listed_since) for r in urlfilter.evaluate(df, entries).collect()}
    none = (False, 0, None, None)
    assert got == {
        1: none, 2: (True, 1, "host", day("2024-01-10")), 3: (True, 3, "prefix", day("2024-02-10")), 4: (True, 1, "domain", day("2024-02-01")),
        5: none, 6: none, 7: none, None: none,
    }
    assert urlfilter.evaluate(df.limit(0), entries).count() == 0 and not any(r.blocked for r in urlfilter.evaluate(df, entries.limit(0)).collect())


def test_address_filter_equals_sql(spark):
    from oracle import connection, difference

    got = urlfilter.op9_url_filters(spark, "/root/testdata/sf0.01").toPandas()
    assert difference(got, connection("/root/testdata/sf0.01").execute(urlfilter.ORACLE_SQL).df()) is None


# all together


def test_stages_work_on_what_was_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
    assert neardup.near_duplicates(spark.read.parquet(str(tmp_path / "minhash_near_dedup"))).where("not kept").count() == 0
    assert repeats.without_repeats(docs.dropDuplicates(["doc_id"]), ["doc_id"]).agg({"n_removed": "sum"}).first()[0] >= 0
    pieces = packing.pack_documents(spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_hard_rows_clashing_columns_and_nothing(spark, hard, nothing):
    names = ["score", "predicted", "__bytes", "tokens", "weight", "epoch", "position", "n_removed", "n_bytes", "n_spans", "kept_text", "kept", "row", "s", "id", "bucket"]
    for rows in (hard, nothing):
        docs = rows.withColumn("n_chars", F.lit(0).cast("long")).withColumns({c: F.lit("mine") for c in names})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            assert out.where(" or ".join(f"`{c}` <> 'mine'" for c in names)).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= rows.count()


def test_stages_equal_plain_versions(spark, prose):
    shared = prose(950, 40)
    rows = [(i, prose(960 + i, 80 + i) + (" " + shared if i % 4 == 0 else ""), "aa", f"s{i % 2}") for i in range(24)]
    for i in range(12):
        words = rows[i][1].split()
        words[7], words[40] = "changed", "again"
        rows.append((100 + i, " ".join(words if i % 3 else words[:30] + ["y"] * 30 + words[30:]), "aa", "s0"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def shingles(text):
        w = text.split()
        return set(zip(*[w[k:] for k in range(5)]))

    texts = {r[0]: r[1] for r in rows}
    sets = {i: shingles(t) for i, t in texts.items()}
    gone = {b for b in sets for a in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    kept = neardup.drop_near_duplicates(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == set(sets) - gone and gone

    seen, left = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        lost = set()
        for k in range(len(data) - 49):
            if data[k : k + 50] in seen:
                lost.update(range(k, k + 50))
        seen |= {data[k : k + 50] for k in range(len(data) - 49)}
        left[i] = bytes(b for k, b in enumerate(data) if k not in lost).decode()
    cut = {r.doc_id: (r.text, r.n_chars) for r in repeats.cut_repeats(spark, docs, SMALL).collect()}
    assert cut == {i: (t, len(t)) for i, t in left.items() if t} and any(left[i] != texts[i] for i in texts)

    # Every document of a source is taken as often as the others of it, but for its last pass.
    taken = Counter(r.doc_id for r in mixing.mix_sources(spark, docs, SMALL).collect())
    by_source = {s: [taken[r[0]] for r in rows if r[3] == s] for s in ("s0", "s1")}
    assert all(max(n) - min(n) <= 1 for n in by_source.values()) and set(taken) <= set(texts)


def test_every_number_has_one_registered_query():
    numbers = Counter(int(m[1]) for n in CATALOG if (m := re.match(r"op(\d+)_", n)))
    assert numbers == Counter(range(1, 14))
    assert set(CATALOG) | {"pipeline"} <= set(entry.queries())
    assert duckdb and entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op1_license_scans", "op2_fingerprints", "op9_url_filters"])
def test_native_plans_have_no_python(spark, name, capsys):
    CATALOG[name][0](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
