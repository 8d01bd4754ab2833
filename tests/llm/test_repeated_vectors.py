"""Nearest neighbours with repeated ids, many equal vectors and small shards."""

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import vptree


def test_repeated_ids_and_equal_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    rows += [(100, [0.5, 0.5, 0.5, 0.5]), (100, [0.5, 0.5, 0.5, 0.5]), (200, rows[100][1]), (7, rows[8][1]), (7, rows[8][1])]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(400)] + [(1001, [1.0, 1.0, 1.0, 1.0])] * 30
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("q", F.lit(1)).repartition(4)
    got = vptree.nearest(df, shard_rows=32).collect()
    want = []
    for own, v in ((i, np.array(v)) for i, v in rows if i % 100 == 0):
        near = sorted((float(np.sqrt(((v - np.array(w)) ** 2).sum())), i) for i, w in rows if i != own)[:10]
        want += [(own, r + 1, i, d) for r, (d, i) in enumerate(near)]
    key = lambda t: (t[0], t[1], t[2], round(t[3], 9))
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(map(key, want))
    cells = vptree._few_of_each(vptree._clean(df), 10)
    assert cells.where("v[0] = 1 and id >= 1000").count() == 11 + 9  # ids 1000..1010, ten rows of id 1001
