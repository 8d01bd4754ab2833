"""Nearest neighbours over several levels of pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import vptree


def _points(n, dim=3, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).round(3)


def _frame(spark, points):
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)


def _brute(points, every, k):
    out = set()
    for q in range(0, len(points), every):
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(points)), far)) if i != q][:k]
        out |= {(q, r + 1, int(i)) for r, i in enumerate(order)}
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_levels_are_exact(spark, hot):
    points = _points(1500)
    if hot:  # a third of all rows in one tiny place
        points[:500] = points[0] + points[:500] * 1e-4
    got = vptree.nearest(_frame(spark, points), every=50, shard_rows=40, fan=4).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == _brute(points, 50, 10)


def test_levels_nest(spark):
    index = vptree.build(vptree._clean(_frame(spark, _points(1500))), 3, 10, shard_rows=40, fan=4)
    assert len(index.levels) >= 2
    assert index.sizes.agg(F.sum("n")).first()[0] == 1500
    assert index.sizes.agg(F.max("n")).first()[0] <= 40


def test_reach_grows_slower_than_the_table(spark):
    small, large = (
        vptree.rows_in_reach(_frame(spark, _points(n)), every=40, shard_rows=32, fan=8).agg(F.avg("n")).first()[0] for n in (800, 6400)
    )
    assert large < small * 8**0.5


def test_rows_no_pivot_tells_apart(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vptree.nearest(df, every=100, k=3, shard_rows=4, fan=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [
        (0, 1, 2), (0, 2, 4), (0, 3, 6), (100, 1, 0), (100, 2, 2), (100, 3, 4), (200, 1, 0), (200, 2, 2), (200, 3, 4)
    ]
