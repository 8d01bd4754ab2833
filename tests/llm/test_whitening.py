"""Whitening against a dense eigendecomposition; secular updates against dense scatter matrices."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import whitening
from attestor.llm.whitening import Spectrum


def brute(vectors, components=4):
    """Fit list, exact deviations and whitened rows by dense algebra in Python integers."""
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, dim = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(dim)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    rows = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    with np.errstate(all="ignore"):
        return n, deviation, values[order] / values.sum(), rows @ basis[:, order] / np.sqrt(values[order])


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.select("*", *[F.lit(7).alias(c) for c in ("n", "v", "name", "component", "part", "state")]).repartition(3)


@pytest.mark.parametrize("count, dim", [(300, 6), (40, 2), (3, 5)])
def test_whitened_equals_dense(spark, count, dim):
    rng = np.random.default_rng(count)
    vectors = (rng.normal(size=(count, dim)) * np.linspace(1, 3, dim)).astype(np.float32)
    vectors[count // 2 :: 3] = vectors[0]  # a third are copies of one vector
    vectors = vectors.tolist()
    broken = [(1000, None), (1001, [None] * dim), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (1004, [1.0])]
    got = whitening.whitened(frame(spark, list(enumerate(vectors)) + broken)).collect()
    n, deviation, explained, want = brute(vectors)
    size = min(4, dim)
    assert len(got) == count * size and {r.n for r in got} == {n}
    table = np.full((count, size), np.nan)
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        if r.whitened is not None:
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
            table[r.vec_id, r.component - 1] = r.whitened
    live = ~np.isnan(table).any(axis=0)
    assert live.sum() == min(size, n - 1)
    for c in np.flatnonzero(live):
        sign = np.sign(table[:, c] @ want[:, c])
        np.testing.assert_allclose(table[:, c], sign * want[:, c], atol=1e-7)


def test_repeats_nulls_zero_variance_and_empty(spark):
    df = frame(spark, [(1, [0.5, -0.0]), (1, [0.5, 0.0]), (None, [0.5, 0.0])])
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id is None, r.component, r.n, r.deviation) for r in got) == sorted([(v, c, 1, 0) for v in (False, False, True) for c in (1, 2)])
    assert all(r.whitened is None and r.explained is None for r in got)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id > 5")).count() == 0
    assert whitening.whitened(frame(spark, [(1, []), (2, [])])).count() == 0


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**30, 1.0], [-(2.0**30), 2.0], [2.0**30, 1.0], [3.0, 2.0**40]]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame(spark, list(enumerate(vectors)))).collect()}
    n, deviation, _, _ = brute(vectors)
    assert [got[i, 1].deviation for i in range(4)] == [d if d < 2**63 else None for d in deviation]


def test_names_are_canonical():
    x = np.array([[1, -1], [127, -128], [128, 0], [40000, 1], [2**40, 1]], np.int64)
    names = whitening._names(x)
    assert [len(b) for b in names] == [2, 2, 4, 8, 16] and len(set(names)) == 5
    assert (np.stack([np.frombuffer(b, f"<i{len(b) // 2}") for b in names]) == x).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 24), st.integers(0, 2**32 - 1), st.integers(0, 6), st.booleans())
def test_rank_one_updates(dim, count, seed, power, axes):
    """Repeated, aligned, equal and widely scaled rows: the updates keep the dense scatter."""
    rng = np.random.default_rng(seed)
    x = np.eye(dim)[rng.integers(0, dim, count)] * 7 if axes else rng.integers(-2, 3, size=(count, dim)) * 10.0**power
    whole, left, right = Spectrum.empty(dim), Spectrum.empty(dim), Spectrum.empty(dim)
    for i, row in enumerate(x):
        whole.add(row)
        (left if i % 2 else right).add(row)
    left.merge(right)
    want = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for s in (whole, left):
        again = Spectrum.from_bytes(s.to_bytes(), dim)
        np.testing.assert_allclose(again.basis @ np.diag(again.values) @ again.basis.T, want, atol=1e-11 * max(1, np.abs(want).max()))
        np.testing.assert_allclose(again.basis.T @ again.basis, np.eye(dim), atol=1e-12)
        np.testing.assert_allclose(again.mean, x.mean(axis=0), atol=1e-9 * 10**power)


def test_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 3)).astype(np.float32).tolist()
    rows = whitening._clean(frame(spark, list(enumerate(vectors)))).repartition(40)
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        model = whitening.fit(rows, 3, 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    np.testing.assert_allclose(model.values, want, rtol=1e-10)
