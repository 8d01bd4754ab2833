"""File readers and sequence operators on small literal files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import genome as GN
from attestor.operators import intervals as IV
from attestor.operators import probing as P
from attestor.sources import genomics as G
from attestor.sources import proteins as PR
from attestor.sources import results as RES


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fasta_multiline_filter_and_prefix(spark, tmp_path):
    path = tmp_path / "p.fasta.gz"
    with gzip.open(path, "wt") as handle:
        handle.write(">sp|P12345|GENE1_HUMAN Some > protein\nMKTAYIAK\nqrqisfvk\n>sp|Q99999|LONG x\n" + "A" * 30 + "\n")
        handle.write(">tr|A0A1|T y\nMKBZ*\n>plain other\nACD\n>empty\n")
    out = _rows(PR.read_fasta(spark, str(path), max_length=20), "unit_id", "sequence")
    assert out == [("A0A1", "MKXXX"), ("P12345", "MKTAYIAKQRQISFVK"), ("plain", "ACD")]
    first = PR.read_fasta(spark, str(path), max_length=20, max_records=2)
    assert {r["unit_id"] for r in first.collect()} == {"P12345", "A0A1"}


GAF = "\n".join(
    [
        "!gaf-version: 2.2",
        "UniProtKB\tP1\tS\t\tGO:1\tR\tEXP\t\tF\td\t\t\t\t\t",
        "UniProtKB\tP1\tS\t\tGO:1\tR\tIDA\t\tF\td\t\t\t\t\t",
        "UniProtKB\tP1\tS\tnot|enables\tGO:2\tR\tEXP\t\tF\td\t\t\t\t\t",
        "UniProtKB\tP2\tS\t\tGO:3\tR\tIEA\t\tC\td\t\t\t\t\t",
        "UniProtKB\tP3\tS\t\tGO:4\tR\tEXP\t\tP\td\t\t\t\t\t",
        "short\tline",
    ]
)


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.gaf"
    path.write_text(GAF)
    assert _rows(PR.read_annotations(spark, str(path)), "unit_id", "concept_id") == [
        ("P1", "GO:1"), ("P2", "GO:3"), ("P3", "GO:4")
    ]
    units = spark.createDataFrame([("P1",), ("P2",)], "unit_id string")
    kept = PR.read_annotations(spark, str(path), units=units, evidence=["EXP", "IDA"], aspects=["F", "C"])
    assert _rows(kept, "unit_id", "concept_id") == [("P1", "GO:1")]
    assert PR.read_annotations(spark, str(path), keep_evidence=True).count() == 4


OBO = """format-version: 1.4
ontology: tools

[Typedef]
id: used_with
name: used with

[Term]
id: GO:1000
name: hand tool

[Term]
id: GO:2100
name: saw
alt_id: GO:2199
is_a: GO:1000 ! hand tool

[Term]
id: GO:2200
name: file
is_a: GO:1000 ! hand tool

[Term]
id: GO:3110
name: fret saw
alt_id: GO:2200
alt_id: GO:3999
is_a: GO:2100 ! saw

[Term]
id: GO:3120
name: wire saw file
is_a: GO:2100 ! saw
is_a: GO:2200 ! file
"""


def test_ontology(spark, tmp_path):
    path = tmp_path / "tools.obo"
    path.write_text(OBO)
    names = dict(_rows(PR.read_concept_names(spark, str(path)), "concept_id", "name"))
    assert names == {
        "GO:1000": "hand tool", "GO:2100": "saw", "GO:2199": "saw", "GO:2200": "file", "GO:3110": "fret saw",
        "GO:3999": "fret saw", "GO:3120": "wire saw file",
    }  # a canonical entry wins over an alias of the same id
    edges, aliases = PR.read_concept_edges(spark, str(path))
    assert {r["child_id"] for r in edges.where("parent_id = 'GO:2100'").collect()} == {"GO:3110", "GO:3120"}
    assert {r["parent_id"] for r in edges.where("child_id = 'GO:3120'").collect()} == {"GO:2100", "GO:2200"}
    sib = P.siblings_of(edges, aliases.where("alt_id = 'GO:2199'"))
    of_alias = {r["sibling_id"] for r in sib.where("concept_id = 'GO:2199'").collect()}
    assert of_alias == {"GO:2100", "GO:2200"}  # an alias has its term's parents and is nobody's child
    assert "GO:2199" not in {r["sibling_id"] for r in sib.collect()}
    resolved = PR.resolve_names(spark.createDataFrame([("GO:2100",), ("GO:7",)], "concept_id string"), PR.read_concept_names(spark, str(path)))
    assert dict(_rows(resolved, "concept_id", "name")) == {"GO:2100": "saw", "GO:7": "GO:7"}


def test_genes_and_elements(spark, tmp_path):
    gtf = tmp_path / "g.gtf"
    gtf.write_text(
        '##x\nchr1\tH\tgene\t1001\t2000\t.\t+\t.\thavana_gene_id "OTT1.1"; gene_id "ENSG1.1"; gene_name "A";\n'
        'chr1\tH\ttranscript\t1001\t2000\t.\t+\t.\tgene_id "ENSG1.1";\nchr1\tH\tgene\t5\t9\t.\t-\t.\tgene_name "B";\n'
        'chr2\tH\tgene\t1\t10\t.\t-\t.\tgene_id "ENSG2.4";\n'
    )
    assert _rows(G.read_genes(spark, str(gtf)), "gene_id", "start", "end", "strand") == [
        ("ENSG1.1", 1000, 2000, "+"), ("ENSG2.4", 0, 10, "-")
    ]
    wanted = spark.createDataFrame([("ENSG2.9",)], "gene_id string")
    assert _rows(G.read_genes(spark, str(gtf), gene_ids=wanted), "gene_id") == [("ENSG2.4",)]
    bed = tmp_path / "e.bed"
    bed.write_text(
        "chr1\t1000\t1200\tE1\t0\t.\t1000\t1200\t0\tPLS,CTCF-bound,PLS\tl\t1\tu\ta\td\nchr2\t5\t9\tE2\t0\t.\t5\t9\t0\t\tl\t1\tu\ta\td\n"
    )
    out = {r["accession"]: sorted(r["classes"]) for r in G.read_elements(spark, str(bed)).collect()}
    assert out == {"E1": ["CTCF-bound", "PLS"], "E2": []}
    assert G.read_elements(spark, str(bed), chroms=["chr2"]).count() == 1


def test_genome_chunks_windows_and_alleles(spark, tmp_path):
    rng = random.Random(1)
    sequences = {name: "".join(rng.choice("acgtN") for _ in range(size)) for name, size in (("chr1", 1000), ("chr2", 333), ("chr3", 64))}
    path = tmp_path / "g.fa"
    with open(path, "w") as handle:
        for name, seq in sequences.items():
            handle.write(f">{name} description\n")
            for i in range(0, len(seq), 60):
                handle.write(seq[i : i + 60] + "\n")
    genome = G.read_genome(spark, str(path), chunk=64).cache()
    for name, seq in sequences.items():
        got = "".join(r["seq"] for r in genome.where(F.col("chrom") == name).orderBy("chunk_start").collect())
        assert got == seq
    lengths = G.chrom_lengths(genome)
    assert dict(_rows(lengths, "chrom", "length")) == {k: len(v) for k, v in sequences.items()}
    tiles = IV.tile_chromosomes(lengths, size=100, stride=100)
    read = GN.window_sequences(tiles, genome, chunk=64)
    for r in read.collect():
        assert r["sequence"] == sequences[r["chrom"]][r["start"] : r["end"]].upper()
    gated = GN.gate_windows(tiles, genome, max_n=0.2, chunk=64)
    expect = {r["window_id"] for r in read.collect() if r["sequence"].count("N") / len(r["sequence"]) <= 0.2}
    assert {r["window_id"] for r in gated.collect()} == expect
    base = sequences["chr1"].upper()
    good = next(i for i in range(200, 300) if base[i] in "ACGT")
    alt = "A" if base[good] != "A" else "C"
    wrong = "A" if base[good] != "A" else "G"
    loci = spark.createDataFrame(
        [("ok", "chr1", good + 1, base[good], alt), ("bad", "chr1", good + 1, wrong, base[good] if base[good] != wrong else "T"),
         ("indel", "chr1", 500, "CT", "C"), ("start", "chr1", 3, "A", "C"), ("end", "chr1", 999, "A", "C"), ("none", "chr9", 50, "A", "C")],
        "locus string, chrom string, pos long, ref string, alt string",
    )
    out = {r["locus"]: r for r in GN.allele_windows(loci, genome, lengths, size=20, chunk=64).collect()}
    start = good - 10
    assert out["ok"]["ref_seq"] == base[start : start + 20] and out["ok"]["window_start"] == start
    assert out["ok"]["alt_seq"] == base[start:good] + alt + base[good + 1 : start + 20]
    assert out["bad"]["problem"].startswith("reference base")
    assert {k: out[k]["problem"] is not None for k in out} == {"ok": False, "bad": True, "indel": True, "start": True, "end": True, "none": True}
    odd = GN.symmetric_allele_windows(loci.where("locus = 'ok'"), genome, lengths, context=5).first()
    assert len(odd["ref_seq"]) == 11


VCF = "\n".join(
    [
        "##fileformat=VCFv4.2",
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3",
        "1\t1000\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/1\t1/1",
        "1\t1005\t.\tCT\tC\t.\t.\t.\tGT\t0|1\t0|0\t0|1",
        "1\t1010\t.\tC\tT\t.\t.\t.\tGT:DP\t.|.:3\t1|0:3\t0|1:3",
        "1\t2000\t.\tC\tT\t.\t.\t.\tGT\t./.\t1/1\t0/0",
        "1\t3000\t.\tG\tA,T\t.\t.\t.\tGT\t0/1\t0/2\t1/1",
    ]
)


def test_variant_calls(spark, tmp_path):
    path = tmp_path / "v.vcf"
    path.write_text(VCF)
    asked = spark.createDataFrame([("chr1", 1000), ("1", 2000), ("1", 3000), ("1", 1005), ("1", 7)], "chrom string, pos long")
    out = _rows(G.read_dosage(spark, str(path), asked), "variant_id", "sample_id", "dosage")
    assert out == [
        ("chr1:1000:A:G", "S1", 0), ("chr1:1000:A:G", "S2", 1), ("chr1:1000:A:G", "S3", 2),
        ("chr1:1005:CT:C", "S1", 1), ("chr1:1005:CT:C", "S2", 0), ("chr1:1005:CT:C", "S3", 1),
        ("chr1:2000:C:T", "S2", 2), ("chr1:2000:C:T", "S3", 0),
    ]
    windows = spark.createDataFrame([("L1", "chr1", 990, 1015), ("L2", "chr1", 5000, 6000), ("L3", "1", 999, 1000)], "locus string, chrom string, start long, end long")
    calls = G.read_window_calls(spark, str(path), windows)
    rows = calls.collect()
    l1 = sorted((r["pos"], r["sample_id"], r["haplotype"], r["allele"]) for r in rows if r["locus"] == "L1")
    assert {r[0] for r in l1} == {1000, 1010}
    assert (1010, "S2", 0, 1) in l1 and (1010, "S2", 1, 0) in l1 and not any(r[1] == "S1" and r[0] == 1010 for r in l1)
    assert [r["pos"] for r in rows if r["locus"] == "L2"] == [None]
    assert {r["pos"] for r in rows if r["locus"] == "L3"} == {1000}


def test_haplotypes(spark):
    windows = spark.createDataFrame([("L", 100, "aCGTACGT")], "locus string, window_start long, ref_seq string")
    samples = spark.createDataFrame([("L", "S1"), ("L", "S2")], "locus string, sample_id string")
    calls = spark.createDataFrame(
        [("L", 101, "A", "T", "S1", 0, 1), ("L", 103, "G", "C", "S1", 0, 1), ("L", 103, "G", "C", "S1", 1, 0),
         ("L", 104, "A", "G", "S1", 1, 1), ("L", 900, "A", "G", "S1", 1, 1), ("L", 108, "T", "A", "S2", 1, 1)],
        "locus string, pos long, ref string, alt string, sample_id string, haplotype byte, allele byte",
    )
    out = {(r["sample_id"], r["haplotype"]): r["sequence"] for r in GN.haplotype_sequences(windows, samples, calls).collect()}
    assert out == {("S1", 0): "TCCTACGT", ("S1", 1): "ACGTACGT", ("S2", 0): "ACGTACGT", ("S2", 1): "ACGTACGA"}


CHAIN = """# comment
chain 100 chr1 1000 + 0 300 chr1 2000 + 500 820 1
100 50 70
150

chain 50 chr1 1000 + 400 500 chr2 900 + 0 100 2
100

chain 40 chr1 1000 + 600 700 chr1 2000 - 100 200 3
100

chain 30 chr1 1000 + 250 260 chr1 2000 + 900 910 4
10
"""


def test_chain_and_lift(spark, tmp_path):
    path = tmp_path / "c.chain"
    path.write_text(CHAIN)
    blocks = G.read_chain(spark, str(path))
    assert _rows(blocks, "src_start", "src_end", "dst_start") == [
        (0, 100, 500), (150, 300, 670), (250, 260, 900), (400, 500, 0), (600, 700, 100)
    ]
    asked = spark.createDataFrame([("chr1", p) for p in (1, 100, 120, 151, 255, 450, 601)], "chrom string, pos long")
    got = {r["pos"]: r["lifted_pos"] for r in IV.lift_positions(asked, blocks).collect()}
    # gap, two hits and another chromosome do not lift; the reverse strand counts back
    assert got == {1: 501, 100: 600, 120: None, 151: 671, 255: None, 450: None, 601: 1900}


def test_sample_tables(spark, tmp_path):
    panel = tmp_path / "panel.tsv"
    panel.write_text("sample\tpop\tsuper_pop\tgender\nS1\tGBR\tEUR\tmale\nS3\tYRI\tAFR\tfemale\n")
    assert _rows(G.read_panel(spark, str(panel)), "sample_id", "superpopulation") == [("S1", "EUR"), ("S3", "AFR")]
    matrix = tmp_path / "e.tsv"
    matrix.write_text("TargetID\tGene_Symbol\tChr\tCoord\tS1\tS2\nG1\tx\t1\t5\t1.5\t-2\nG2\ty\t1\t6\t0\tNA\n")
    assert _rows(G.read_expression(spark, str(matrix)).where("value is not null"), "gene_id", "sample_id", "value") == [
        ("G1", "S1", 1.5), ("G1", "S2", -2.0), ("G2", "S1", 0.0)
    ]
    with pytest.raises(ValueError):
        G.read_expression(spark, str(matrix), gene_column="gene")
    eqtl = tmp_path / "q.tsv"
    eqtl.write_text("rs1985842\t-\tENSG00000198951.6\tp\t22\t22\t42523409\t1\t2\t0.1\t1e-5\t5\n")
    assert _rows(G.read_candidates(spark, str(eqtl)), "variant_id", "chrom", "pos", "gene_id") == [
        ("rs1985842", "chr22", 42523409, "ENSG00000198951.6")
    ]


def test_sweep_reader_and_registries(spark, tmp_path):
    import json

    row = {"go_id": "GO:A", "go_name": "a", "n_positives": 20, "n_total": 100, "single_feature_auroc": 0.8, "best_feature_idx": 5, "held_out_auroc": None, "auroc_inflation": 0.1}
    for point, text in (("mp20", json.dumps([row])), ("mp100", "[]"), ("mp50", "{broken")):
        (tmp_path / point).mkdir()
        (tmp_path / point / "results.json").write_text(text)
    out = RES.read_sweep(spark, str(tmp_path), model="m")
    assert _rows(out, "model", "min_positives", "concept_id", "best_feature_idx") == [("m", 20, "GO:A", 5)]
    assert out.first()["held_out_auroc"] is None
    reg = tmp_path / "r.yaml"
    reg.write_text("features:\n  5:\n    status: confirmed\n    claimed_go: [GO:A]\n    claimed_concept: c\n")
    assert _rows(RES.import_registry_yaml(spark, str(reg), model="m"), "feature_idx", "status") == [(5, "confirmed")]
