"""The pipeline on a small corpus: every stage against what it must keep and drop."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    good = "The words of this text are plain and it is easy to read them with care. Every sentence ends in the way that one would expect of it. "
    texts = [good * 2, (good * 2).replace(" ", "  ", 3), good * 2 + "Write to jo@mail.example.com now.", "THE!! WORDS!! " * 40, "x### y%%% z&&& " * 30, None, good + "Other words follow here as the last of all."]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, "")
        if name != "packing":
            assert seen.columns == docs.columns
        ids = sorted(r.doc_id for r in seen.collect())
        if name == "quality_classifier":
            assert {0, 1, 2, 6} <= set(ids)
        if name == "exact_dedup":
            assert 0 not in ids and 1 in ids
        if name == "personal_data":
            assert ids == sorted(r.doc_id for r in before.collect())
            assert not seen.where("text like '%@%'").count()
    assert set(ids) == {r.doc_id for r in before.collect()}
    assert {"sequence_id", "offset", "length"} <= set(seen.columns)
