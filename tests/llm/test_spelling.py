"""Spelling variants against a plain search over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helioquant.llm import spelling
from helioquant.llm.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.001"


def counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(words):
    """Each word's row, from its deletions and replacements looked up among the words less a letter."""
    by_hole = {}
    for w in words:
        for i in range(len(w)):
            by_hole.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for group in by_hole.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in near:
                near[w].add(less)
                near[less].add(w)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w], root(w), words[w], len(near[w]), words.get(forms[w])) for w in words)


def got(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


@pytest.fixture(scope="module")
def words():
    """Few letters and lengths around seven, so that most words have neighbours; long ones beside them."""
    rng = random.Random(4)
    made = {"".join(rng.choices("abc", k=rng.randint(7, 9))): rng.choice([2, 3, 25, 40, 900, 20000]) for _ in range(900)}
    made |= {"".join(rng.choices("abéÿ", k=rng.randint(1, 4))): 5 for _ in range(20)}
    base = "".join(rng.choices("abcdef", k=70))
    for size in (31, 32, 33, 34, 70):
        made[base[:size]] = 10**size.bit_length()
        made[base[: size - 1] + "z"] = 2
        made["z" + base[1:size]] = 3
        made[base[:20] + base[21:size]] = 4
    made |= {"x" * 900: 2, "x" * 901: 50, "x" * 450 + "y" + "x" * 450: 7, "x" * 902 + "y": 9}
    return made


def test_plain_search_is_plain(words):
    some = sorted(words)[:150]
    for w, _, _, _, n_near, _ in plain({w: words[w] for w in some}):
        assert n_near == sum(one_edit(w, x) for x in some)


def test_all_pairs(spark, words):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({c: F.lit("x") for c in ("side", "node", "form", "root", "at")})
    result = got(spelling.variant_forms(frame.repartition(5)))
    assert result == plain(words)
    assert sum(r[4] for r in result) > 1000 and any(r[2] not in (r[0], r[1]) for r in result)


def test_one_hot_prefix(spark):
    rng = random.Random(5)
    words = {"interna" + "".join(rng.choices("ab", k=rng.randint(1, 8))): rng.randint(2, 60) for _ in range(400)}
    words |= {w[::-1]: n for w, n in words.items()}
    assert got(spelling.variant_forms(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_hard_rows(hard, hard_rows, nothing, spark):
    docs = hard.withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "id")})
    assert got(spelling.variant_forms(spelling.counted_words(docs))) == plain(counts(r[:2] for r in hard_rows))
    assert spelling.variant_forms(spelling.counted_words(nothing)).collect() == []
    rows = [(i, "CaminantÉ WANDERER x×÷ÿabcd Ābcdefgh " * 3) for i in range(60)] + [(None, "wanderer"), (None, "wanderer")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.counted_words(texts).select("word", F.lit(None).alias("form"), "word", "n", "n", "n").toDF("word", "form", "root", "n", "n_near", "form_n")) == sorted(
        (w, None, w, n, n, n) for w, n in counts(rows).items()
    )


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    result = got(CATALOG["op11_spelling_variants"][0](spark, SF_DIR))
    assert result == plain(counts(rows)) and any(r[1] for r in result)
