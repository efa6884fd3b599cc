"""Operators with known answers: alpha grids, greedy and graph clusters, haplotype blocks, zips, INFO edits, new commands."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.__main__ import main
from strandline.operators import clustering, intervals, pileup, variants
from tests.test_files import SAM, VCF


def bases(spark, rng, genotypes, mixes, n_snps, depth=6):
    """Reads of cells that mix two samples (s1, s2, share of s2)."""
    rows = []
    for cell, (a, b, share) in enumerate(mixes):
        for snp in range(n_snps):
            for umi in range(depth):
                who = b if rng.random() < share else a
                alt = rng.random() < genotypes[who][snp] / 2
                rows.append((cell, snp, umi, int(alt), 35, 1))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["cell", "snp", "umi", "allele", "bq", "n"]).astype({"n": "int64"}))


def test_alpha_grid(spark):
    rng = np.random.default_rng(3)
    genotypes = rng.integers(0, 3, (4, 120))
    mixes = [(0, 0, 0.0), (1, 1, 0.0), (2, 3, 0.5), (3, 0, 0.2)]
    panel = spark.createDataFrame([(s, v, int(genotypes[s][v]) + 1) for s in range(4) for v in range(120)], "sample int, snp int, code int")
    out = pileup.demultiplex(bases(spark, rng, genotypes, mixes, 120), pileup.genotype_shares(panel, 0.01), alphas=(0.5, 0.2)).collect()
    got = {r.cell: r for r in out}
    assert [got[c].type for c in range(4)] == ["SNG", "SNG", "DBL", "DBL"]
    assert (got[0].sng_best, got[1].sng_best) == (0, 1) and (got[2].dbl_1, got[2].dbl_2) == (2, 3) and (got[3].dbl_1, got[3].dbl_2) == (3, 0)


def test_greedy_clusters(spark):
    rng = np.random.default_rng(4)
    genotypes = rng.integers(0, 3, (3, 150))
    reads = bases(spark, rng, genotypes, [(i % 3, i % 3, 0.0) for i in range(18)], 150)
    snps = spark.createDataFrame([(v, float(np.clip(genotypes[:, v].mean() / 2, 0.05, 0.95))) for v in range(150)], "snp int, af double")
    nine = pileup.nine_state(reads)
    got = {r.cell: r.cluster for r in clustering.greedy_clusters(nine, snps, pileup.singlet_score(nine, snps), 3, share=1.0).collect()}
    assert len(got) == 18 and len({(c % 3, k) for c, k in got.items()}) == 3


def test_communities(spark):
    edges = [(i, j, 1.0) for base in (0, 10, 20) for i in range(base, base + 6) for j in range(base, i)] + [(0, 10, 0.1), (10, 20, 0.1)]
    got = {r.node: r.community for r in clustering.communities(spark.createDataFrame(edges, "a int, b int, w double")).collect()}
    assert len(got) == 18 and len(set(got.values())) == 3 and len({(n // 10, c) for n, c in got.items()}) == 3


def test_haplotype_blocks(spark):
    rows = []
    for s in range(10):
        for pos in range(1, 17):
            rows.append(("1", pos, f"s{s}", (s + pos) % 2, pos % 2))
        rows.append(("1", 3_0, f"s{s}", int(s == 0), 0))
    g = spark.createDataFrame(rows, "chrom string, pos int, sample string, a1 int, a2 int")
    out = variants.haplotype_blocks(g, 8, 0.06)
    assert out.select("block").distinct().count() == 2 and out.agg(F.sum("n")).first()[0] == 40
    assert {len(r.haplotype) for r in out.collect()} == {8}


def test_zip_refuses_other_sites(spark):
    a = spark.createDataFrame([(1,), (2,)], "pos int")
    assert variants.zip_sites(a, a, ["pos"]).count() == 2
    with pytest.raises(ValueError):
        variants.zip_sites(a, a.filter("pos = 1"), ["pos"])


def test_info_edits(spark):
    key = ("1", 5, "A", ["G"])
    schema = "chrom string, pos int, ref string, alts array<string>, info map<string,string>"
    mine = spark.createDataFrame([(*key, {"A": "1", "B": "2", "C": "3"}), ("1", 6, "A", ["G"], {"A": "9"})], schema)
    other = spark.createDataFrame([(*key, {"B": "20", "A": "10", "D": "40"})], schema)
    got = {r.pos: r.info for r in variants.update_info(mine, other, remove=["C"], replace=["B"], add=["A", "D"]).collect()}
    assert got == {5: {"A": "1", "B": "20", "D": "40"}, 6: {"A": "9"}}
    ids = spark.createDataFrame([("1_4_A_G",), ("rs5",)], "id string").select(variants.canonical_id(F.col("id")).alias("id")).collect()
    assert [r.id for r in ids] == ["1:5:A:G", "rs5"]


@pytest.fixture()
def files(tmp_path):
    for name, body in {
        "a.vcf": VCF, "a.sam": SAM, "a.fa": ">1\n" + "ACGTTGCA" * 40 + "\n>2\n" + "GGCCATAT" * 20 + "\n", "pos.bed": "1\t9\t40\n1\t50\t90\n", "neg.bed": "2\t9\t40\n2\t60\t100\n",
        "m.tsv": "gene\tA\tB\tC\ng1\t9\t0\t8\ng2\t0\t7\t1\n", "h.m3vcf": "##x\n#CHROM\n1\t1\t.\t.\t.\t.\t.\tVARIANTS=1;REPS=2\tGT\t0|1\n1\t10\ta\tA\tC\t.\t.\t.\t1\n",
    }.items():
        (tmp_path / name).write_text(body)
    return tmp_path


def run(spark, files, *args):
    out = f"{files}/out"
    assert main([*args, "--out", out], spark) == 0
    return [r.asDict() for r in spark.read.csv(out, sep="\t", header=True).collect()]


def test_new_commands(spark, files):
    f = f"{files}"
    rows = run(spark, files, "vcf-update-sites", "--vcf", f"{f}/a.vcf", "--remove", "DB", "--dbsnp", f"{f}/a.vcf")
    assert {(r["pos"], r["id"]) for r in rows} >= {("100", "rs1"), ("50", "rs3")} and all("DB" not in (r["info"] or "") for r in rows)
    made = run(spark, files, "bed-delta-svm-train", "--positive", f"{f}/pos.bed", "--negative", f"{f}/neg.bed", "--fasta", f"{f}/a.fa", "--model", f"{f}/model", "--length", "8", "--k", "5")
    assert made[0]["sequences"] == "4"
    delta = run(spark, files, "vcf-delta-svm", "--vcf", f"{f}/a.vcf", "--fasta", f"{f}/a.fa", "--model", f"{f}/model")
    assert {r["pos"] for r in delta} == {"100", "200", "50"} and all(float(r["delta"]) == float(r["delta"]) for r in delta)
    assert {r["cell"] for r in run(spark, files, "verify-pair-id", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf")} == {"c0", "c1"}
    assert {r["cell"] for r in run(spark, files, "mux-pileup", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf")} == {"c0", "c1"}
    assert {r["fragment"] for r in run(spark, files, "digital-pileup", "--sam", f"{f}/a.sam")} == {"1:91-95", "1:98-107"}
    assert len(run(spark, files, "dsc-dump", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf", "--dump", f"{f}/dump")) == 3
    assert {r["barcode"]: r["n"] for r in run(spark, files, "dsc-dump2plp", "--dump", f"{f}/dump")} == {"c0": "2", "c1": "2"}
    z = run(spark, files, "sc-multinom-em", "--matrix", f"{f}/m.tsv", "--clusters", "2")
    assert {r["cell"] for r in z} == {"A", "B", "C"} and len(z) == 6
    assert len(run(spark, files, "sc-multinom-gibbs", "--matrix", f"{f}/m.tsv", "--clusters", "2")) == 3
    assert [r["allele"] for r in sorted(run(spark, files, "m3vcf-subsample", "--m3vcf", f"{f}/h.m3vcf", "--haplotypes", "0,1"), key=lambda r: r["haplotype"])] == ["0", "1"]
    assert len(run(spark, files, "vcf-ref-phase", "--vcf", f"{f}/a.vcf", "--size", "2")) > 0
    assert run(spark, files, "run-test", "--tsv", f"{f}/m.tsv")[0]["lines"] == "3"
    moved = run(spark, files, "bed-matched-shuffle", "--bed", f"{f}/pos.bed", "--places", f"{f}/pos.bed", "--fasta", f"{f}/a.fa")
    assert all(int(r["to_end"]) - int(r["to_beg"]) == int(r["end"]) - int(r["beg"]) for r in moved)


def test_pairs_without_opposite_homozygotes(spark, monkeypatch):
    """Blocks of three samples, sites two at a time, against all pairs."""
    monkeypatch.setattr(variants, "SAMPLE_BLOCK", 3)
    monkeypatch.setattr(variants, "PRODUCT_CELLS", 8)
    rng = np.random.default_rng(7)
    codes = rng.choice(4, (11, 6), p=[0.2, 0.15, 0.5, 0.15])
    codes[10] = 2
    rows = [(s, v, int(codes[s, v])) for s in range(11) for v in range(6)]
    got = {(r.id1, r.id2) for r in variants.ibs0_free_pairs(spark.createDataFrame(rows, "sample int, snp int, code int")).collect()}
    usable = [v for v in range(6) if (codes[:, v] == 1).any() and (codes[:, v] == 3).any()]
    want = {(i, j) for i in range(11) for j in range(i + 1, 11) if not any({codes[i, v], codes[j, v]} == {1, 3} for v in usable)}
    assert got == want and 0 < len(want) < 55


def test_cells_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    genotypes = rng.integers(0, 3, (3, 40))
    nine = pileup.nine_state(bases(spark, rng, genotypes, [(i % 3, i % 3, 0.0) for i in range(9)], 40, 2))
    snps = spark.createDataFrame([(v, 0.3) for v in range(40)], "snp int, af double")
    whole = sorted((r.id1, r.id2, r.n_snps, round(r.ldiff, 8)) for r in pileup.pair_bayes_factors(nine, snps).collect())
    monkeypatch.setattr(pileup, "CELL_BLOCK", 2)
    assert sorted((r.id1, r.id2, r.n_snps, round(r.ldiff, 8)) for r in pileup.pair_bayes_factors(nine, snps).collect()) == whole and len(whole) == 36


def test_intervals_merge_over_borders(spark):
    rng = np.random.default_rng(9)
    rows = [(int(c), int(b), int(b + w)) for c, b, w in zip(rng.integers(0, 2, 300), rng.integers(-500, 5000, 300), rng.integers(0, 60, 300))]
    table = spark.createDataFrame(rows, "chrom int, beg int, end int")
    for adjacent in (False, True):
        got = sorted(map(tuple, intervals.merge_intervals(table, adjacent=adjacent, width=64).select("chrom", "beg", "end").collect()))
        want = []
        for c, b, e in sorted(rows):
            if want and want[-1][0] == c and b <= want[-1][2] + adjacent:
                want[-1] = (c, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((c, b, e))
        assert got == want
