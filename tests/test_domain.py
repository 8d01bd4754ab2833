"""Intervals, verdicts, agreement, prompts, vectors and mediation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import prompts as PR
from attestor.functions import text as TX
from attestor.operators import agreement as G
from attestor.operators import intervals as IV
from attestor.operators import mediation as M
from attestor.operators import registry as R
from attestor.operators import vectors as V
from attestor.sources import activations as ACT


@pytest.mark.parametrize("broadcast_rows", [0, 50_000])
def test_overlap_join_equals_nested_loop(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(IV, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(11)
    left = [(i, rng.choice("ab"), s, s + rng.choice([1, 50, 4000, 90000])) for i, s in enumerate(rng.randrange(0, 300000) for _ in range(150))]
    right = [(i, rng.choice("ab"), s, s + rng.choice([1, 300, 5000, 2_200_000, 17])) for i, s in enumerate(rng.randrange(0, 300000) for _ in range(150))]
    right += [(900, "a", 10, 10), (901, "a", 20, 5)]
    lf = spark.createDataFrame(left, "l long, chrom string, start long, end long")
    rf = spark.createDataFrame(right, "r long, chrom string, start long, end long")
    out = [(x["l"], x["r"]) for x in IV.overlap_join(lf, rf, bin_size=1024).collect()]
    expected = [(a[0], b[0]) for a in left for b in right if b[2] < b[3] and a[1] == b[1] and a[2] < b[3] and a[3] > b[2]]
    assert sorted(out) == sorted(expected)
    plan = IV.overlap_join(lf, rf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_window_labels_boundaries(spark):
    elements = spark.createDataFrame(
        [("1", 1000, 1200, ["PLS", "CTCF-bound"]), ("1", 900, 1100, ["dELS"])], "chrom string, start long, end long, classes array<string>"
    )
    windows = spark.createDataFrame(
        [("contains", "1", 0, 5000), ("far", "1", 5000, 6000), ("partial", "1", 1000, 2000), ("touch", "1", 800, 900), ("other", "2", 0, 5000)],
        "window_id string, chrom string, start long, end long",
    )
    out = {r["window_id"]: r["classes"] for r in IV.label_windows(windows, elements).collect()}
    assert out == {"contains": ["CTCF-bound", "PLS", "dELS"], "far": [], "partial": ["CTCF-bound", "PLS", "dELS"], "touch": [], "other": []}


def test_genomic_verdicts(spark):
    genes = spark.createDataFrame([("G1.1", "c", 0, 10000), ("G2.1", "c", 50000, 60000)], "gene_id string, chrom string, start long, end long")
    claims = spark.createDataFrame(
        [(1, "G1.9"), (2, "G1.9"), (3, "G9"), (4, None), *[(5, g) for g in ("G1.1", "G1.1", "G2", "G3", "G4", "G5")]], "feature_idx int, gene_id string"
    )
    windows = {1: ["c:0-100", "c:200-300", "c:900-1000"], 2: ["c:0-100", "c:20000-20100", "c:30000-30100"], 3: ["c:0-100"], 5: ["c:0-100", "bad"]}
    evidence = spark.createDataFrame([(f, w) for f, ws in windows.items() for w in ws], "feature_idx int, window_id string")
    out = {r["feature_idx"]: r for r in IV.genomic_verdicts(claims, evidence, genes).collect()}
    assert {k: v["status"] for k, v in out.items()} == {1: "confirmed", 2: "plausible", 3: "spurious", 4: "unverifiable", 5: "spurious"}
    assert out[1]["match_rate"] == 1.0 and out[2]["match_rate"] == pytest.approx(1 / 3)
    assert out[5]["match_rate"] == 0.0 and out[5]["n_claims"] == 6 and out[5]["n_windows_matched"] == 1
    shown = {f: [(w["window_id"], w["genes"]) for w in r["evidence"]] for f, r in out.items()}
    assert shown[2] == [("c:0-100", ["G1.1"]), ("c:20000-20100", []), ("c:30000-30100", [])] and shown[4] == [] and shown[5] == [("c:0-100", ["G1.1"])]
    ranked = evidence.where("feature_idx = 1").withColumn("rank", -F.substring("window_id", 3, 1).cast("int"))
    row = IV.genomic_verdicts(claims, ranked, genes).where("feature_idx = 1").first()
    assert [w["window_id"] for w in row["evidence"]] == ["c:900-1000", "c:200-300", "c:0-100"]


def test_tiling(spark):
    chroms = spark.createDataFrame([("chr1", 1000), ("chr2", 50)], "chrom string, length long")
    tiles = IV.tile_chromosomes(chroms, size=100, stride=100).orderBy("start").collect()
    assert len(tiles) == 10 and tiles[0]["window_id"] == "chr1:0-100"
    with pytest.raises(ValueError):
        IV.tile_chromosomes(chroms, size=100, stride=100, offset=100)
    genes = spark.createDataFrame([("G", "chr1", 100, 300), ("S", "chr2", 10, 20)], "gene_id string, chrom string, start long, end long")
    out = IV.tile_genes(genes, chroms, size=100, stride=50, flank=2000).collect()
    assert len(out) == 19 and {r["gene_id"] for r in out} == {"G"}


def test_window_id_parsing(spark):
    df = spark.createDataFrame([("G:chr1:0-100",), ("chr1:5-9",), ("bad",), ("a:b",)], "w string")
    out = [tuple(r["p"]) if r["p"] else None for r in df.select(TX.parse_window_id(F.col("w")).alias("p")).collect()]
    assert out == [("G:chr1", 0, 100), ("chr1", 5, 9), None, None]


def kappa(pairs):
    order = {"spurious": 0, "plausible": 1, "confirmed": 2}
    codes = [(order[a], order[b]) for a, b in pairs if a in order and b in order]
    levels = sorted({v for p in codes for v in p})
    index = {v: i for i, v in enumerate(levels)}
    if len(levels) < 2:
        return None
    n = len(codes)
    observed = sum(abs(index[a] - index[b]) for a, b in codes) / n
    expected = sum(abs(index[a] - index[b]) for a, _ in codes for _, b in codes) / n / n
    return 1 - observed / expected


def test_agreement_matches_definition(spark):
    rng = random.Random(6)
    names = ["confirmed", "plausible", "spurious", "unverifiable"]
    groups = {"all": names, "two": ["confirmed", "spurious"], "one": ["spurious"], "off": ["unverifiable"]}
    rows = [(g, i, rng.choice(v), rng.choice(["low", "medium", "high"]), rng.choice(v), rng.choice(["low", "medium", "high"])) for g, v in groups.items() for i in range(60)]
    df = spark.createDataFrame(rows, "g string, feature_idx int, status_a string, confidence_a string, status_b string, confidence_b string")
    out = {r["g"]: r for r in G.agreement(df, keys=["g"]).collect()}
    rank = {"low": 0, "medium": 1, "high": 2}
    for g in groups:
        mine = [r for r in rows if r[0] == g]
        expected = kappa([(r[2], r[4]) for r in mine])
        assert out[g]["weighted_kappa"] == (None if expected is None else pytest.approx(expected))
        assert out[g]["percent_agreement"] == pytest.approx(np.mean([r[2] == r[4] for r in mine]))
        assert out[g]["n_excluded"] == sum(r[2] != r[4] and rank[r[3]] == rank[r[5]] for r in mine)
    assert out["off"]["percent_agreement_on_scale"] is None


def test_incomplete_or_invalid_sheets_are_rejected(spark):
    key = spark.createDataFrame([(1, "confirmed", True), (2, "spurious", False)], "feature_idx int, status string, is_trap boolean")
    a = spark.createDataFrame([(1, "confirmed", "high")], "feature_idx int, status string, confidence string")
    with pytest.raises(Exception, match="lacks feature 2"):
        G.pair_annotators(a, a, key).collect()
    sheet = spark.createDataFrame([(1, " Confirmed", "HIGH", "seen"), (2, "maybe", "high", "x"), (3, "spurious", "low", " ")], "feature_idx int, status string, confidence string, justification string")
    valid, bad = G.split_completed(sheet)
    assert [r["feature_idx"] for r in valid.collect()] == [1]
    assert {r["feature_idx"]: r["problem"] for r in bad.collect()} == {2: "unknown status", 3: "empty justification"}
    with pytest.raises(ValueError):
        G.require_completed(sheet)


def test_packets_are_disjoint_and_merge_refuses_duplicates(spark):
    names = ["confirmed", "plausible", "spurious", "unverifiable"]
    registry = spark.createDataFrame([(i, names[i % 4]) for i in range(60)], "feature_idx int, status string")
    packets = R.annotator_packets(registry, shared_per_status=5, expansion_per_annotator=6, seed="1")
    rows = packets.collect()
    assert len({r["feature_idx"] for r in rows}) == len(rows) == 15 + 15 + 12
    assert sum(r["is_trap"] for r in rows) == 2
    merged = R.merge_packets(packets, packets.select("feature_idx", "status", "is_trap"), seed="1").collect()
    assert sorted(r["position"] for r in merged) == list(range(1, 43))
    with pytest.raises(ValueError, match="several"):
        R.merge_packets(packets.unionByName(packets), packets, seed="1")


def test_verdict_parsing(spark):
    texts = [
        '{"status": "confirmed", "confidence": "high", "reasoning": "ok"}', '```json\n{"status": "spurious", "confidence": "low", "reasoning": "no"}\n```',
        "not json", '{"status": "confirmed", "confidence": "high"}', '{"status": "maybe", "confidence": "high", "reasoning": "x"}',
        '{"status": "confirmed", "confidence": "sure", "reasoning": "x"}', "[1, 2]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    out = {r["i"]: (r["status"], r["problem"]) for r in PR.parse_verdicts(df).collect()}
    assert out[0] == ("confirmed", None) and out[1] == ("spurious", None)
    assert [out[i][1] for i in range(2, 7)] == ["not a JSON object", "missing keys: reasoning", "unknown status", "unknown confidence", "not a JSON object"]
    assert all(out[i][0] is None for i in range(2, 7))


def _dictionary(spark, d, m, seed=0):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(d, m))
    rows = [(i, [float(v) for v in w[i]], 0.1 * (i % 3), [float(v) for v in w[i][::-1]]) for i in range(d)]
    return spark.createDataFrame(rows, "feature_idx int, w_enc array<double>, b_enc double, w_dec array<double>"), w


def test_topk_encoding_blocks_and_relu(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(64, 32))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "unit_id int, vec array<double>")
    table, w = _dictionary(spark, 48, 32)
    h = (x - 0.2) @ w.T + 0.1 * (np.arange(48) % 3)
    whole = V.Dictionary(table, [0.2] * 32)
    split = V.Dictionary(table, [0.2] * 32, max_bytes=20 * (16 * 32 + 16))
    assert split.block_rows == 20
    for k in (8, 48):
        expected = set()
        for i in range(64):
            for f in sorted(range(48), key=lambda f: (-h[i, f], f))[:k]:
                if h[i, f] > 0:
                    expected.add((i, f))
        for dictionary in (whole, split):
            rows = V.topk_encode(vectors, dictionary, k).collect()
            assert {(r["unit_id"], r["feature_idx"]) for r in rows} == expected
            assert all(r["act"] == pytest.approx(h[r["unit_id"], r["feature_idx"]]) for r in rows)
    only = V.topk_encode(vectors, split, 8, features=[3, 25]).collect()
    assert {r["feature_idx"] for r in only} <= {3, 25} and only
    features = V.topk_encode(vectors, split, 8)
    rebuilt = {r["unit_id"]: np.array(r["vec"]) for r in V.decode(features, vectors, split).collect()}
    z = np.zeros((64, 48))
    for r in features.collect():
        z[r["unit_id"], r["feature_idx"]] = r["act"]
    hat = z @ w[:, ::-1] + 0.2
    assert np.allclose([rebuilt[i] for i in range(64)], hat)
    m = V.reconstruction_metrics(vectors, features, V.decode(features, vectors, whole), table).first()
    assert m["mse"] == pytest.approx(np.mean((x - hat) ** 2))
    assert m["frac_variance_explained"] == pytest.approx(1 - np.mean((x - hat) ** 2) / np.var(x, ddof=1))
    assert m["dead_fraction"] == pytest.approx(np.mean((z > 0).mean(0) < 1e-3)) and m["mean_l0"] == pytest.approx((z > 0).sum(1).mean())


def test_dictionary_blocks_keep_gapped_ids(spark):
    rng = np.random.default_rng(8)
    ids = [0, 1, 2, 500, 9000, 9001, 70000]
    w = rng.normal(size=(len(ids), 4))
    rows = [(i, [float(x) for x in v], 0.1, [float(x) for x in v]) for i, v in zip(ids, w, strict=True)]
    table = spark.createDataFrame(rows, "feature_idx int, w_enc array<double>, b_enc double, w_dec array<double>")
    units = spark.createDataFrame([(u, [float(x) for x in rng.normal(size=4)]) for u in range(9)], "unit_id long, vec array<double>")
    whole = V.Dictionary(table, [0.0] * 4)
    small = V.Dictionary(table, [0.0] * 4, max_bytes=160)
    assert whole.n_blocks == 1 and small.n_blocks == 4
    assert [i for b in small.blocks() for i in b["idx"].tolist()] == ids
    get = lambda df: {(r.unit_id, r.feature_idx): round(r.act, 9) for r in df.collect()}
    features = V.topk_encode(units, whole, 3)
    assert get(features) == get(V.topk_encode(units, small, 3))
    decoded = [{r.unit_id: np.round(r.vec, 9).tolist() for r in V.decode(features, units, d).collect()} for d in (whole, small)]
    assert decoded[0] == decoded[1]
    with pytest.raises(ValueError):
        V.Dictionary(table.unionByName(table), [0.0] * 4)


def test_prompts_keep_the_top_lines(spark):
    claims = spark.createDataFrame([(1,), (2,)], "feature_idx int")
    lines = spark.createDataFrame([(1, r, f"line {r}") for r in range(5)], "feature_idx int, rank int, line string")
    out = {r.feature_idx: r.prompt for r in PR.assemble_prompts(claims, lines, claim=F.lit("c"), rules="R", top_k=2).collect()}
    assert "line 1" in out[1] and "line 2" not in out[1] and "NONE" in out[2]


def test_token_pooling(spark):
    rows = [("a", i, False, [float(i), 1.0]) for i in range(5)] + [("a", 5, True, [99.0, 99.0])] + [("b", 0, False, [1.0, 1.0]), ("b", 1, False, [3.0, 3.0])]
    tokens = spark.createDataFrame(rows, "unit_id string, pos int, is_pad boolean, vec array<double>")
    mean = {r["unit_id"]: r["vec"] for r in V.pool_tokens(tokens).collect()}
    assert mean == {"a": [2.0, 1.0], "b": [0.0, 0.0]}
    keep = {r["unit_id"]: r["vec"] for r in V.pool_tokens(tokens, drop_first=False, drop_last=False).collect()}
    assert keep == {"a": [2.0, 1.0], "b": [2.0, 2.0]}
    assert {r["unit_id"]: r["vec"] for r in V.pool_tokens(tokens, pooling="cls").collect()}["a"] == [0.0, 1.0]


def test_unknown_lookup_and_missing_stats_fail(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(60)], "unit_id int, vec array<double>, shard_id int")
    path = str(tmp_path / "acts")
    ACT.write_shard(rows, path)
    back = ACT.read_vectors(spark, path)
    assert ACT.dataset_stats(back).first()["n_rows"] == 60 and ACT.dataset_stats(back).first()["n_shards"] == 3
    assert [r["unit_id"] for r in ACT.lookup(back, [7, 3, 50]).collect()] == [7, 3, 50]
    with pytest.raises(Exception, match="unknown unit id"):
        ACT.lookup(back, [7, 777]).collect()
    empty = V.norm_stats(rows).limit(0)
    with pytest.raises(Exception, match="no normalization stats"):
        V.normalize(rows, empty).collect()


def _locus(rng, n, fraction, total=2.0):
    t = rng.integers(0, 3, n).astype(float)
    m = t + rng.normal(0, 0.5, n)
    y = total * (1 - fraction) * t + total * fraction * m + rng.normal(0, 0.5, n)
    return t, m, y


def test_mediation_recovers_planted_fraction(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fraction in (0.0, 0.3, 0.7, 1.0):
        t, m, y = _locus(rng, 445, fraction)
        rows += [(f"{fraction}", f"s{i}", float(a), float(b), float(c), "EUR" if i % 2 else "AFR") for i, (a, b, c) in enumerate(zip(t, m, y))]
    rows += [("constant", f"s{i}", float(i % 3), 1.0, float(i % 3 + (i % 7) / 10), "EUR") for i in range(100)]
    df = spark.createDataFrame(rows, "locus string, sample_id string, t double, m double, y double, superpopulation string")
    out = {r["locus"]: r for r in M.mediation(df, keys=["locus"], category="superpopulation").collect()}
    for fraction in ("0.0", "0.3", "0.7", "1.0"):
        assert out[fraction]["proportion"] == pytest.approx(float(fraction), abs=0.15)
        assert out[fraction]["acme_lo"] <= out[fraction]["acme"] <= out[fraction]["acme_hi"]
        assert out[fraction]["acme_reportable"] and out[fraction]["proportion_reportable"]
    assert out["1.0"]["acme_p"] < 0.05
    assert not out["constant"]["acme_reportable"] and out["constant"]["acme"] == pytest.approx(0.0, abs=1e-9)
    control = {r["locus"]: r["acme_p"] for r in M.negative_control(df, keys=["locus"], category="superpopulation").collect()}
    assert all(p > 0.05 for p in control.values())
    star = {r["locus"]: r["rho_star"] for r in M.zero_crossing(M.sensitivity_curve(M.mediation(df, keys=["locus"]), keys=["locus"]), keys=["locus"]).collect()}
    assert 0 < star["0.7"] < 0.9


def test_moment_regression_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    n = 300
    t, m, y = _locus(rng, n, 0.4)
    level = rng.choice(["AFR", "EAS", "EUR"], n)
    age = rng.normal(40, 9, n)
    y = y + 0.3 * (level == "EUR") + 0.02 * age
    rows = [("l", i, float(t[i]), float(m[i]), float(y[i]), str(level[i]), float(age[i])) for i in range(n)]
    # another locus has a level this one lacks
    rows += [("k", i, float(i % 3), float(i % 5), float(i % 7), "SAS" if i % 2 else "EUR", 1.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "locus string, sample_id long, t double, m double, y double, superpopulation string, age double")
    got = {r["locus"]: r for r in M.mediation(df, keys=["locus"], numeric=["age"], category="superpopulation", n_rep=10).collect()}["l"]
    dummies = np.column_stack([(level == v).astype(float) for v in ("EAS", "EUR")])
    one = np.ones(n)
    x1 = np.column_stack([one, t, age, dummies])
    x2 = np.column_stack([one, t, m, age, dummies])
    b1, *_ = np.linalg.lstsq(x1, m, rcond=None)
    b2, *_ = np.linalg.lstsq(x2, y, rcond=None)
    assert got["beta"] == pytest.approx(b1[1]) and got["delta"] == pytest.approx(b2[2]) and got["ade"] == pytest.approx(b2[1])
    assert got["sigma_1"] == pytest.approx(np.std(m - x1 @ b1, ddof=1)) and got["sigma_2"] == pytest.approx(np.std(y - x2 @ b2, ddof=1))
    base = {r["locus"]: r for r in M.baseline_regression(df, keys=["locus"], predictor="t", method="twas_style", numeric=["age"], category="superpopulation").collect()}["l"]
    b3, *_ = np.linalg.lstsq(x1, y, rcond=None)
    rss = np.sum((y - x1 @ b3) ** 2)
    assert base["coefficient"] == pytest.approx(b3[1]) and base["r_squared"] == pytest.approx(1 - rss / np.sum((y - y.mean()) ** 2))


def test_missing_panel_sample_is_an_error(spark):
    rows = spark.createDataFrame([("l", "s1"), ("l", "s2")], "locus string, sample_id string")
    panel = spark.createDataFrame([("s1", "EUR")], "sample_id string, superpopulation string")
    with pytest.raises(Exception, match="s2"):
        M.add_ancestry(rows, panel).collect()


def test_haplotypes_scored_once_per_sequence(spark):
    rows = [("l", "a", 0, "AC"), ("l", "a", 1, "ACGT"), ("l", "b", 0, "AC"), ("l", "b", 1, "AC")]
    haplotypes = spark.createDataFrame(rows, "locus string, sample_id string, haplotype int, sequence string")

    def scorer(unique):
        return unique.select("sequence_id", F.lit(0).alias("feature_idx"), F.length("sequence").cast("double").alias("act"))

    out, counts = M.score_haplotypes(haplotypes, scorer, keys=["locus"])
    assert {r["sample_id"]: r["m"] for r in out.collect()} == {"a": 3.0, "b": 2.0}
    assert tuple(counts.select("n_unique", "n_total").first()) == (2, 4)
