import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalar
from strandline.operators import clustering, intervals, kernels, pileup, reads, variants


def test_simplex():
    at, value, _ = kernels.simplex(lambda v: (v[0] - 3) ** 2 + 10 * (v[1] + 1) ** 2 + 2, [0.0, 0.0])
    assert np.allclose(at, [3, -1], atol=1e-3) and abs(value - 2) < 1e-6


def panel_of(rnd, n_samples=12, n_snps=60):
    group = np.arange(n_samples) % 2
    af = np.where(group[:, None] == 0, rnd.uniform(0.05, 0.4, n_snps), rnd.uniform(0.6, 0.95, n_snps))
    return rnd.binomial(2, af), group


@pytest.mark.parametrize("exact", [2048, 0])
def test_components_and_ancestry(spark, monkeypatch, exact):
    """By the square of the samples, and by the sketch."""
    monkeypatch.setattr(kernels, "EXACT_SAMPLES", exact)
    g, group = panel_of(np.random.default_rng(1))
    rows = [(f"s{i}", k, float(g[i, k])) for i in range(len(g)) for k in range(g.shape[1])]
    ud, v = kernels.principal_components(spark.createDataFrame(rows, "sample string, snp int, ds double"), 2)
    x = g - g.mean(axis=0)
    u, d, vt = np.linalg.svd(x.T, full_matrices=False)
    mine = np.array([r.v for r in v.orderBy("sample").collect()])
    want = vt.T[[int(r.sample[1:]) for r in v.orderBy("sample").collect()], :2]
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)
    like = [(f"s{i}", k, *[1.0 if g[i, k] == c else 1e-4 for c in range(3)]) for i in range(len(g)) for k in range(g.shape[1])]
    fit = kernels.infer_ancestry(spark.createDataFrame(like, "sample string, snp int, l0 double, l1 double, l2 double"), ud, 1).collect()
    side = {r.sample: r.pc1 > 0 for r in fit}
    assert len({(side[f"s{i}"], group[i]) for i in range(len(g))}) == 2
    assert all(r.llk1 >= r.llk0 for r in fit)


def test_contamination(spark):
    rnd = np.random.default_rng(2)
    n = 300
    af = rnd.uniform(0.2, 0.8, n)
    own, other = rnd.binomial(2, af), rnd.binomial(2, af)
    rows = []
    for name, share in (("clean", 0.0), ("mixed", 0.2)):
        for k in range(n):
            for _ in range(20):
                g = other[k] if rnd.random() < share else own[k]
                rows.append((name, k, int(rnd.random() < (0.001 if g == 0 else 0.5 if g == 1 else 0.999)), 30))
    loadings = spark.createDataFrame([(k, float(af[k]), [0.0]) for k in range(n)], "snp int, af double, ud array<double>")
    fit = {r["sample"]: r.alpha for r in kernels.contamination(spark.createDataFrame(rows, "sample string, snp int, allele int, bq int"), loadings, 1).collect()}
    assert fit["clean"] < 0.02 and abs(fit["mixed"] - 0.2) < 0.04


def test_individual_frequencies_and_em(spark):
    g, group = panel_of(np.random.default_rng(3), 20, 4)
    like = [(k, f"s{i}", *[1.0 if g[i, k] == c else 1e-6 for c in range(3)]) for i in range(20) for k in range(4)]
    df = spark.createDataFrame(like, "snp int, sample string, l0 double, l1 double, l2 double")
    vectors = spark.createDataFrame([(f"s{i}", [float(2 * group[i] - 1) / math.sqrt(20)]) for i in range(20)], "sample string, v array<double>")
    got = {(r.snp, r["sample"]): r.isaf for r in kernels.individual_frequencies(df, vectors, max_lambda=0.01).collect()}
    for k in range(4):
        for side in (0, 1):
            mean = g[group == side, k].mean() / 2
            assert all(abs(got[k, f"s{i}"] - mean) < 0.08 for i in range(20) if group[i] == side)
    em = {r.snp: r for r in kernels.genotype_em(df).collect()}
    for k in range(4):
        assert abs(em[k].af - g[:, k].mean() / 2) < 1e-3 and abs(em[k].gf1 - (g[:, k] == 1).mean()) < 1e-3 and em[k].lrt > -1e-6


def test_phasing():
    f = kernels.phase_counts(np.array([[0, 0], [2, 2], [1, 1], [1, 1], [0, 0], [2, 2]]))
    assert f[0] > 0.45 and f[3] > 0.45 and f[1] + f[2] < 0.1


def test_svm(spark):
    rnd = random.Random(1)
    make = lambda motif: "".join(rnd.choice("ACGT") for _ in range(12)) + motif + "".join(rnd.choice("ACGT") for _ in range(12))
    seqs = [make("TTGACGTCAA") for _ in range(10)] + [make("".join(rnd.choice("ACGT") for _ in range(10))) for _ in range(10)]
    model = kernels.train_svm(seqs, [1] * 10 + [0] * 10, length=8, k=5, most=3)
    hits = sum(kernels.svm_score(model, make("TTGACGTCAA")) > kernels.svm_score(model, make("CCCCCCCCCC")) for _ in range(8))
    assert hits >= 7 and abs(kernels.gkm_kernel("ACGTACGTAC", "GTACGTACGT", length=6, k=4, most=2) - 1) < 1e-9
    row = spark.createDataFrame([("ACGTTTGA", "C", "A", "GTCAAACG")], "left string, ref string, alt string, right string")
    assert kernels.delta_scores(row, model).first().delta < 0


@pytest.mark.parametrize("z, sign", [(3.0, 1), (-3.0, -1)])
def test_signed_p(z, sign):
    assert abs(kernels.signed_log10_p(z) - sign * 2.5687) < 1e-3


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(scalar.string_hash(F.lit("ACGT"))) == 67660287 and abs(pick(scalar.unit_hash(F.lit("ACGT"))) - 0.4298084992751965) < 1e-15
    assert pick(scalar.error_of(F.lit(1.0))) == 0.75 and abs(pick(scalar.error_of(F.lit(20.0))) - 0.01) < 1e-12
    assert [pick(scalar.phred_of(F.lit(e))) for e in (0.01, 0.0, 1.0)] == [20, 255, 0]
    assert pick(scalar.genotype_index(F.lit(2), F.lit(1))) == 4
    assert [tuple(pick(scalar.parse_region(F.lit(t)))) for t in ("1:5-9", "chr2:1,000", "X")] == [("1", 5, 9), ("chr2", 1000, 1000), ("X", 1, (1 << 29) - 1)]
    kinds = {("A", "G"): "SNP", ("A", "AC"): "INDEL", ("GACT", "GACTACT"): "INDEL", ("AC", "GT"): "MNP", ("CAT", "CGT"): "SNP", ("A", "<DEL>"): "SV", ("A", "A"): "REF", ("AT", "GCC"): "CLUMPED"}
    for (r, a), kind in kinds.items():
        assert pick(scalar.classify_variant(F.lit(r), F.lit(a))) == kind, (r, a)
    assert pick(scalar.ploidy(F.lit("chrX"), F.lit(2699520), F.lit(True))) == 1 and pick(scalar.ploidy(F.lit("X"), F.lit(2699519), F.lit(True))) == 2
    assert pick(scalar.reverse_complement(F.lit("AACG"))) == "CGTT" and pick(scalar.attribute(F.lit('gene_id "x"; tag y'), "gene_id")) == "x"


def test_likelihoods_match_worked_values(spark):
    bases = spark.createDataFrame([(0, 0, 1, 0, 20, 1), (1, 0, 1, 0, 20, 1), (1, 0, 2, 1, 30, 1)], "cell int, snp int, umi int, allele int, bq int, n long")
    three = {r.cell: r for r in pileup.three_state(bases).collect()}
    assert np.allclose([three[0].g0, three[0].g1, three[0].g2], [0.66442953, 0.333333333, 0.002237136], atol=1e-6)
    assert np.allclose([three[1].g0, three[1].g1, three[1].g2, three[1].log_denominator], [0.001310419, 0.985466258, 0.013223323, -1.379009847], atol=1e-6)
    nine = {r.cell: r for r in pileup.nine_state(bases).collect()}[1]
    assert np.allclose([nine.g00, nine.g01, nine.g11, nine.g12, nine.g22], [0.000166, 0.124509, 0.166208, 0.125261, 0.00167], atol=1e-6)
    assert abs(nine.log_denominator - 0.40271) < 1e-4
    score = pileup.singlet_score(pileup.nine_state(bases.filter("cell = 1")), spark.createDataFrame([(0, 0.3)], "snp int, af double")).first()
    assert np.allclose([score.llk2, score.llk0, score.score], [-2.658706, -2.256182, -0.402524], atol=1e-4)


def test_pooled_em_matches_worked_values(spark):
    pls = spark.createDataFrame([(0, 0, 0, 10, 50), (0, 1, 20, 0, 20), (0, 2, 60, 10, 0)], "snp int, sample int, pl0 int, pl1 int, pl2 int")
    for rounds, want in ((1, 0.500002292), (2, 0.500002731), (3, 0.500002816)):
        assert abs(variants.pooled_af_em(pls, rounds).first().af - want) < 1e-8


def test_clusters(spark):
    rnd = np.random.default_rng(5)
    af = rnd.uniform(0.3, 0.7, 150)
    people = rnd.binomial(2, af, size=(2, 150))
    rows, truth = [], {}
    for cell in range(16):
        who = truth[cell] = cell % 2
        for snp in rnd.choice(150, 60, replace=False):
            for umi in range(3):
                rows.append((cell, int(snp), umi, int(rnd.random() < people[who, snp] / 2), 30, 1))
    bases = spark.createDataFrame(rows, "cell int, snp int, umi int, allele int, bq int, n long")
    snps = spark.createDataFrame([(k, float(af[k])) for k in range(150)], "snp int, af double")
    nine = pileup.nine_state(bases).checkpoint()
    start = clustering.seed_clusters(nine, snps, pileup.singlet_score(nine, snps), 2, share=1.0, rounds=2)
    calls, genotypes = clustering.cluster_cells(nine, snps, start, rounds=3)
    found = {r.cell: r.sng_best for r in calls.collect() if r.type == "SNG"}
    assert len(found) >= 14 and len({(found[c], truth[c]) for c in found}) == 2
    assert set(r.gt for r in clustering.cluster_calls(genotypes).collect()) == {0, 1, 2}


def test_bases_through_cigars(spark):
    r = spark.createDataFrame([("a", "1", 91, "5S5M2D10M", "NNNNNACGTACCGCCCCCCC", "I" * 20), ("b", "1", 98, "3M5N3M", "ACGTTT", "ABCDEF")], "qname string, chrom string, pos int, cigar string, seq string, qual string")
    sites = spark.createDataFrame([("1", 100), ("1", 96), ("1", 102), ("1", 107)], "chrom string, pos int")
    got = {(x.qname, x.site): (x.base, x.bq) for x in reads.base_at(r, sites).collect()}
    assert got == {("a", 100): ("G", 40), ("a", 102): ("C", 40), ("a", 107): ("C", 40), ("b", 100): ("G", 34), ("b", 107): ("T", 36)}
    assert [x.v for x in r.select(reads.aligned_length(F.col("cigar")).alias("v")).collect()] == [17, 11]
    sound = spark.createDataFrame([("10M",), ("2S3M1I4M",), ("1I5M",), ("5M2S3M",), ("4S",)], "c string").select(reads.sound_cigar(F.col("c")).alias("v")).collect()
    assert [x.v for x in sound] == [True, True, False, False, False]


def test_interval_shuffle(spark):
    a = spark.createDataFrame([("1", 10, 20, 0), ("1", 40, 45, 0)], "chrom string, beg int, end int, stratum int")
    b = spark.createDataFrame([("2", 100 * i, 100 * i + 5, 0) for i in range(5)], "chrom string, beg int, end int, stratum int")
    out = intervals.shuffle_intervals(a, b, 3).collect()
    assert len(out) == 2 and len({r.to_beg for r in out}) == 2 and all(r.to_end - r.to_beg == r.end - r.beg for r in out)


def test_mixture(spark):
    rows = [(c, g, 20 if g // 5 == c % 2 else 1) for c in range(10) for g in range(10)]
    start = [(k, g, 0.12 if g // 5 == k else 0.08) for k in range(2) for g in range(10)]
    z, p, _ = pileup.mixture_em(spark.createDataFrame(rows, "cell int, gene int, umis int"), spark.createDataFrame(start, "cluster int, gene int, p double"), 3)
    assert all(r.z > 0.99 for r in z.filter("cluster = cell % 2").collect())
    assert all(abs(r.t - 1) < 1e-9 for r in p.groupBy("cluster").agg(F.sum("p").alias("t")).collect())
