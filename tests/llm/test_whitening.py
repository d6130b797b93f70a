"""Operator 11 against a plain eigendecomposition, and its rank-one updates by themselves."""

import math

import numpy as np
import pytest

from tessarine.llm import whitening
from tessarine.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x array<int>, part int, id string, component int"


def fixed(c):
    return [math.floor(64 * v) + 1_000_000 for v in c]


def plain(rows, k=16):
    """What op11 should say of (id, vector) rows of one length, eigenvectors apart."""
    kept = [(i, fixed(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check(got, rows, k=16):
    kept, n, sums, values, vectors, trace = plain(rows, k)
    k = len(values)
    assert len(got) == len(kept) * k
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, r)
    sign = None
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        mine = by_id[i, deviation]
        assert sorted(mine) == list(range(1, k + 1)) and mine[1].n == n
        want = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        have = np.array([mine[c].whitened for c in range(1, k + 1)])
        sign = np.sign(have * want) if sign is None or (sign == 0).any() else sign
        assert np.allclose(have, want * sign, atol=1e-8)
        assert np.allclose([mine[c].explained for c in range(1, k + 1)], values / trace, rtol=1e-9)
        assert {mine[c].identity_error for c in mine} <= {mine[1].identity_error} and mine[1].identity_error < 1e-9


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((400, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(wide)]
    odd = [(500, None), (501, [1.0] * 19 + [None]), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (3, rows[7][1]), (None, rows[9][1])]
    odd += [(600 + k, rows[11][1]) for k in range(150)]  # a third of all rows are one vector
    table = spark.createDataFrame([(i, v, 1, [1], 2, "y", 3) for i, v in rows + odd], SCHEMA)
    check(whitening.whitened(table).collect(), rows + odd)


def test_short_vectors_give_fewer_components(spark):
    rows = [(i, [float(i % 7), float(i * i % 11), 0.25]) for i in range(40)]
    table = spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)
    check(whitening.whitened(table).collect(), rows, 2)  # the third direction has no variance


def test_lengths_apart_and_nothing_to_whiten(spark):
    one = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    table = lambda rows: spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)
    assert whitening.whitened(table(one)).collect() == []
    assert whitening.whitened(table([(1, []), (2, None)])).collect() == []
    assert whitening.whitened(table([])).collect() == []
    rows = [(i, [float(i), float(i * i % 5)]) for i in range(9)]
    got = whitening.whitened(table(rows + [(90, [1.0]), (91, [3.0])])).collect()
    check([r for r in got if r.vec_id < 90], rows)
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in got if r.vec_id >= 90) == [(90, 1, 2, 1.0, 1.0), (91, 1, 2, 1.0, 1.0)]


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(op11_whitening(spark, d).collect(), rows)


@pytest.mark.parametrize("kind", ["plain", "equal", "few", "far"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((300, 24)) * 8 * (1 + np.arange(24))).astype(np.int64)
    if kind == "equal":
        x[:, 4:12], x[:, 18:] = x[:, [4]], 3
    if kind == "few":
        x = x[:15]
    if kind == "far":
        x += 2**30
    parts = [whitening.Spectrum.empty(24) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 3].add(row)
    whole = parts[0]
    for p in parts[1:]:
        whole.unite(p)
    y = x - x.mean(axis=0)
    scatter, largest = y.T @ y, np.abs(y).max() ** 2 * len(x)
    assert whole.n == len(x) and (whole.sums == x.sum(axis=0)).all()
    assert np.abs(whole.basis * whole.lam @ whole.basis.T - scatter).max() < 1e-9 * largest
    assert np.abs(whole.basis.T @ whole.basis - np.eye(24)).max() < 1e-11
