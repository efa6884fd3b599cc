import numpy as np
import pandas as pd

from strandline.operators import genotyping, pileup


def test_normal_form(spark):
    seq = "GGGCACACACAGGG"
    # a deletion of one CA unit, written at its right end, moves to the left of the repeat
    assert genotyping.normal_form(9, "ACA", "A", seq[:8]) == (3, "GCA", "G")
    assert genotyping.normal_form(4, "CAC", "CAT", seq[:3]) == (6, "C", "T")
    bins = spark.createDataFrame([("1", 0, seq[:8]), ("1", 1, seq[8:])], "chrom string, bin int, seq string")
    v = spark.createDataFrame([("1", 9, "ACA", "A"), ("1", 4, "CAC", "CAT")], "chrom string, pos int, ref string, alt string")
    got = {(r.pos, r.ref, r.alt) for r in genotyping.normalise(v, bins, 8).collect()}
    assert got == {(3, "GCA", "G"), (6, "C", "T")}


def test_pairs(spark):
    rnd = np.random.default_rng(1)
    people = rnd.integers(0, 3, size=(3, 200))
    shares = [(s, k, *[0.98 if people[s, k] == g else 0.01 for g in range(3)]) for s in range(3) for k in range(200)]
    bases = []
    for cell, parts in enumerate(((0,), (1, 2))):
        for k in range(200):
            for umi in range(4):
                who = parts[rnd.integers(len(parts))]
                bases.append((cell, k, umi, int(rnd.random() < people[who, k] / 2), 30, 1))
    b = spark.createDataFrame(bases, "cell int, snp int, umi int, allele int, bq int, n long")
    s = spark.createDataFrame(shares, "sample int, snp int, p0 double, p1 double, p2 double")
    got = {r.cell: r for r in genotyping.verify_pairs(genotyping.pair_likelihoods(b, s, (0.0, 0.25, 0.5))).collect()}
    assert got[0].sm_id == 0 and got[0].gain < 0
    assert {got[1].sm1_id, got[1].sm2_id} == {1, 2} and got[1].gain > 2 and got[1].alpha == 0.5
    calls = {r.cell: r.type for r in pileup.demultiplex(b, s).collect()}
    assert calls == {0: "SNG", 1: "DBL"}


def test_gibbs():
    rows = pd.DataFrame([(c, g, 20 if g // 5 == c % 2 else 1) for c in range(10) for g in range(10)], columns=["cell", "gene", "umis"])
    z = genotyping.mixture_gibbs(rows, 2, 10).set_index("cell")["cluster"]
    assert len({(z[c], c % 2) for c in range(10)}) == 2
