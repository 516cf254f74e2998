"""Whitening against plain exact sums, and numpy's eigenvectors."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioquant.llm import whitening
from helioquant.llm.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def usable(rows):
    lengths = [len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    commonest = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    return [
        (i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
        if v and len(v) == commonest and all(c is not None and math.isfinite(c) for c in v)
    ]


def check(frame, rows, components=4):
    """Compare with a plain computation; returns the rows by id."""
    whole = usable(rows)
    fit = sorted({tuple(x) for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    away = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], object)
    cov = np.array([[float(Fraction(int((away[:, i] * away[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values = np.linalg.eigvalsh(cov)[::-1]
    got = frame.collect()
    positive = sum(v > 1e-9 * values[0] for v in values)
    k = min(components, positive)
    assert len(got) == k * len(whole)
    assert sorted({r.component for r in got}) == list(range(1, k + 1))
    by_vector = {}
    ids = {}
    for i, x in whole:
        ids.setdefault(i, []).append(tuple(x))
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        if len(set(ids[r.vec_id])) == 1:
            x = ids[r.vec_id][0]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert by_vector.setdefault((x, r.component), r.whitened) == r.whitened
    # The whitened values are the projections on eigenvectors: least squares gives the components back.
    centred = np.array([[float(Fraction(int(v), n)) for v in row] for row in away])
    known = [x for x in fit if (x, 1) in by_vector]
    w = np.array([[by_vector[x, c] for c in range(1, k + 1)] for x in known])
    rows_of = [fit.index(x) for x in known]
    if len(known) == n:
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
        directions = centred.T @ w / n / np.sqrt(values[:k])
        assert np.abs(cov @ directions - directions * values[:k]).max() < 1e-9 * values[0]
        assert np.abs(centred[rows_of] @ directions / np.sqrt(values[:k]) - w).max() < 1e-8
    return got


def test_hard_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (61, None), (62, []), (63, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (64, [float("nan")] * 6), (65, [float("inf")] + [0.0] * 5), (66, [0.0] * 6), (67, [-0.0] * 6), (68, [1.0, 2.0]),
             (69, [300.0, -200.0, 40.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "x", "dim", "component", "whitened", "deviation")})
    got = check(whitening.whiten(df.repartition(5)), rows)
    assert any(r.vec_id is None for r in got) and not any(r.vec_id in (61, 62, 63, 64, 65, 68) for r in got)


def test_few_dimensions_low_rank_and_equal_roots(spark):
    line = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(9)]
    assert {r.component for r in check(whitening.whiten(spark.createDataFrame(line, SCHEMA)), line)} == {1}
    cross = [(i, [s * float(k == i // 2) for k in range(5)]) for i in range(10) for s in [1 if i % 2 else -1]]
    got = check(whitening.whiten(spark.createDataFrame(cross, SCHEMA)), cross)
    assert {round(r.explained, 12) for r in got} == {0.2}
    two = [(1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [3.0, 1.0])]
    assert {r.component for r in check(whitening.whiten(spark.createDataFrame(two, SCHEMA)), two)} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_fit(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries(spark):
    rows = [(1, [1e38, 1.0]), (2, [0.0, 70000.0]), (3, [-1e38, 0.0]), (4, [5.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and all(r.identity_error < 1e-6 for r in got) and all(r.deviation is None for r in got if r.vec_id in (1, 3))


def test_products_are_exact():
    rng = random.Random(1)
    for reach in (100, 1 << 25, 1 << 62):
        x = np.array([[rng.randint(-reach, reach) for _ in range(4)] for _ in range(50)], np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(x) == want
    for v in (0, 5, -5, 1 << 150, -(1 << 150) + 7):
        assert sum(p << (32 * k) for k, p in enumerate(whitening._parts_of(v))) == v


def test_polynomial_and_roots(spark):
    rng = random.Random(2)
    half = [[rng.randint(-9, 9) for _ in range(7)] for _ in range(5)]
    matrix = [[sum(a * b for a, b in zip(x, y)) for y in zip(*half)] for x in zip(*half)]  # rank 5 of 7
    c = whitening.characteristic_polynomial(spark, matrix)
    assert c[:2] == [0, 0] and c[7] == 1 and c[6] == -sum(matrix[i][i] for i in range(7))
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    roots = whitening.largest_roots(c, 9)
    assert sum(r.times for r in roots) == 5
    assert np.allclose([float(r.value) for r in roots], values[:5])
    # (x - 2)^3 (x - 1) x: a root of three counts three times.
    assert [(round(float(r.value), 9), r.times) for r in whitening.largest_roots([0, 8, -20, 18, -7, 1], 4)] == [(2.0, 3), (1.0, 1)]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    check(CATALOG["op12_embedding_whitening"][0](spark, SF_DIR), rows)
