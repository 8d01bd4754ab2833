"""The locus study shuffles no sample for the sake of small tables, and stores what it reads."""

from attestor.plans import locus_study
from attestor.workload import load_catalog


def test_samples_stay_where_loci_are_small(spark, sf, monkeypatch):
    stored = []

    def seen(df):
        stored.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return store(df)

    store = locus_study.materialize
    monkeypatch.setattr(locus_study, "materialize", seen)
    assert load_catalog()[0]["d57_locus_study"](spark, sf).count() > 0
    columns, plan = next(x for x in stored if "superpopulation" in x[0])
    assert set(columns) == {"locus", "sample_id", "t", "y", "superpopulation"}
    assert "hashpartitioning(variant_id" not in plan and "hashpartitioning(locus" not in plan
    assert plan.count("hashpartitioning(sample_id") == 2  # the rows and the panel, once each
