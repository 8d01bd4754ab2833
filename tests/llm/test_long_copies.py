"""Long texts are named in time that follows their length."""

import time

from attestor.llm import block_names


def test_long_texts(spark):
    """Two equal texts of millions of characters with astral ones, and one that differs at its end."""
    base = "".join(chr(0x4E00 + i % 1000) + chr(0x1F600 + i % 60) + "ab" for i in range(1_000_000))
    df = spark.createDataFrame([(1, base), (2, " " + base), (3, base[:-1] + "x"), (4, "short")], "doc_id bigint, text string").repartition(2)
    begin = time.perf_counter()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in block_names.exact_groups(df).collect()}
    print("seconds", time.perf_counter() - begin)
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


def test_blocks_hold_code_points(spark):
    rows = [(i, "\U0001f600" * n) for i, n in enumerate((3, 4, 7, 8, 7))]
    df = spark.createDataFrame(rows, "_row bigint, _norm string")
    names = {r._row: (r.level, r.name) for r in block_names.identities(df, 4).collect()}
    assert names[2] == names[4] and len(set(names.values())) == 4
    assert [names[i][0] for i in range(4)] == [0, 0, 1, 1]
