"""Inbreeding and individual frequencies: known answers, an independent walk through the formulas, and chains of sites."""

import math
import random

import numpy as np
import pytest

from strandline.operators import dense, inbreeding, variants


def panel(n=200, m=6, theta=0.0, seed=1):
    """Likelihoods of genotypes drawn with inbreeding; frequencies differ along one vector."""
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=n)
    v = (v - v.mean()) / np.linalg.norm(v - v.mean())
    rows, truth = [], []
    for k in range(m):
        p = np.clip(0.2 + 0.1 * k + 0.6 * v, 0.02, 0.98)
        g = np.array([rnd.choice(3, p=inbreeding.inbred(np.array(x), np.array(theta), np.array(1e-9))) for x in p])
        truth.append(p)
        rows += [(k, f"s{i:03d}", *[1.0 if g[i] == c else 1e-3 for c in range(3)], 2) for i in range(n)]
    return rows, [(f"s{i:03d}", [float(v[i])]) for i in range(n)], truth


def frames(spark, rows, vectors):
    return spark.createDataFrame(rows, "snp int, sample string, l0 double, l1 double, l2 double, copies int"), spark.createDataFrame(vectors, "sample string, v array<double>")


@pytest.mark.parametrize("theta", [0.0, 0.4])
def test_theta_and_frequencies(spark, theta):
    rows, vectors, truth = panel(theta=theta)
    like, v = frames(spark, rows, vectors)
    for r in inbreeding.inbreeding_em(like, v).collect():
        assert r.n == 200 and abs(r.theta - theta) < 0.2
        assert r.llk10 > r.llk00 and (r.llk11 >= r.llk10 or r.z_own == 0)
        assert (r.slp_own > 3) == (theta > 0) and abs(r.z_own) == pytest.approx(math.sqrt(max(0, 2 * (r.llk11 - r.llk10))))
        got = {x["sample"]: x.p for x in r.isaf}
        want = dict(zip(sorted(got), truth[r.snp]))
        assert np.corrcoef([got[s] for s in sorted(got)], [want[s] for s in sorted(got)])[0, 1] > 0.9
    for r in inbreeding.inbreeding_search(like, v).collect():
        assert abs(r.theta - theta) < 0.2 and r.llk1 >= r.llk0 - 1e-6
        assert (abs(r.z_own) > 3) == (theta > 0)


def walk(like, copies, vectors, max_lambda, rounds):
    """The same fit sample by sample."""
    n = len(like)
    low = max(1e-5, 0.5 / (2 * n + 1))
    p = 0.5
    for _ in range(10):
        s = 0.0
        for (a, b, c), k in zip(like, copies):
            if k == 2:
                w = (a * (1 - p) ** 2, b * 2 * p * (1 - p), c * p * p)
                s += (w[1] + 2 * w[2]) / sum(w)
            elif k == 1:
                s += c * p / (a * (1 - p) + c * p)
        p = min(max(s / sum(copies), low), 1 - low)
    flip, maf = p > 0.5, min(p, 1 - p)
    lam = max_lambda * (1 - maf) / (maf * n * 2)
    u, d, _ = np.linalg.svd(np.column_stack((np.ones(n), vectors)), full_matrices=False)
    project = u @ np.diag(d**2 / (d + lam) ** 2) @ u.T
    shares = {"E": [p] * n, "D": [p] * n}
    theta = 0.0

    def genotype(q, t):
        e = [(1 - q) ** 2, 2 * q * (1 - q), q * q]
        f = [e[0] + t * e[1] / 2, e[1] * (1 - t), e[2] + t * e[1] / 2]
        if f[0] < low * low:
            f = [low * low, e[1] + 2 * e[0] - 2 * low * low, e[2] - e[0] + low * low]
        elif f[2] < low * low:
            f = [e[0] - e[2] + low * low, e[1] + 2 * e[2] - 2 * low * low, low * low]
        return f

    for _ in range(rounds):
        num = den = 0.0
        ys = {}
        for name, t in (("E", 0.0), ("D", theta)):
            y = []
            for q, (a, b, c), k in zip(shares[name], like, copies):
                if k == 2:
                    f = genotype(q, t) if name == "D" else [(1 - q) ** 2, 2 * q * (1 - q), q * q]
                    w = (a * f[0], b * f[1], c * f[2])
                    y.append((w[1] + 2 * w[0 if flip else 2]) / sum(w))
                    if name == "D":
                        num += w[1] / sum(w)
                    else:
                        den += 2 * q * (1 - q)
                elif k == 1:
                    w = (a * (1 - q), c * q)
                    y.append(2 * w[0 if flip else 1] / sum(w))
                else:
                    y.append(2 * (1 - q if flip else q))
            ys[name] = project @ np.array(y) / 2
        shares = {k: [min(max(1 - x if flip else x, low), 1 - low) for x in y] for k, y in ys.items()}
        theta = 1 - num / den

    def llk(qs, t):
        out = 0.0
        for q, (a, b, c), k in zip(qs, like, copies):
            f = genotype(q, t)
            out += math.log(a * f[0] + b * f[1] + c * f[2]) if k == 2 else math.log(a * (1 - q) + c * q) if k == 1 else 0.0
        return out

    return p, theta, llk([p] * n, 0), llk([p] * n, theta), llk(shares["E"], 0), llk(shares["D"], theta), shares["D"]


def test_fit_step_by_step(spark):
    rnd = random.Random(4)
    rows, vectors = [], [(f"s{i:02d}", [rnd.uniform(-1, 1), rnd.uniform(-1, 1)]) for i in range(14)]
    for k in range(9):
        for i in range(14 if k % 3 else 11):
            rows.append((k, f"s{i:02d}", rnd.random() + 1e-3, rnd.random() * (0.05 if k % 2 else 1) + 1e-3, rnd.random() * (3 if k > 4 else 0.3) + 1e-3, rnd.choice([2, 2, 2, 1, 0])))
    like, v = frames(spark, rows, vectors)
    got = {r.snp: r for r in inbreeding.inbreeding_em(like, v, 0.7, 5, "copies").collect()}
    assert len(got) == 9 and any(r.af > 0.5 for r in got.values()) and any(r.theta < 0 for r in got.values())
    for k in range(9):
        own = sorted(r for r in rows if r[0] == k)
        want = walk([r[2:5] for r in own], [r[5] for r in own], np.array([x for s, x in vectors if s in {r[1] for r in own}]), 0.7, 5)
        r = got[k]
        assert [r.af, r.theta, r.llk00, r.llk01, r.llk10, r.llk11] == pytest.approx(list(want[:6]), rel=1e-8)
        assert [x.p for x in r.isaf] == pytest.approx(want[6], rel=1e-8)


def greedy(rows, d):
    out, last = [], {}
    for c, p in sorted(set(rows)):
        if c not in last or p - last[c] >= d:
            last[c] = p
            out.append((c, p))
    return sorted(out)


@pytest.mark.parametrize("distance, width", [(1, 64), (7, 8), (50, 64), (50, 1 << 16), (333, 64), (20, 500)])
def test_chains_of_sites(spark, distance, width):
    rnd = random.Random(distance)
    rows = [(rnd.choice("ab"), rnd.randint(1, 4000)) for _ in range(700)] + [("c", 5), ("d", 9), ("d", 9)]
    rows += [("e", 10_000 * i + rnd.randint(0, 9)) for i in range(12)] + [("f", i) for i in range(400)]
    sites = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 3, "x"), ("a", None, "x")], "chrom string, pos int, k string")
    got = variants.min_distance(sites, distance, bin_width=width).collect()
    want = set(greedy(rows, distance))
    assert sorted((r.chrom, r.pos) for r in got) == sorted(r for r in rows if r in want)
    assert variants.min_distance(sites.limit(0), distance).count() == 0


def test_alleles_of_reads(spark):
    reads = spark.createDataFrame(
        [("s", 0, "1", 101, 60, "10M", "ACGTACGTAC", "I" * 10), ("s", 16, "1", 101, 60, "2S4M2D4M", "GGACGTACGT", "5" * 10),
         ("s", 0, "1", 101, 60, "4M3I3M", "ACGTTTTACG", "I" * 10), ("s", 0, "1", 101, 60, "4M2I4M", "ACGTTTACGA", "I" * 10), ("t", 0, "2", 101, 60, "10M", "ACGTACGTAC", "I" * 10),
         ("s", 0, "1", 98, 60, "8M", "ACGTACGT", "I" * 8), ("s", 0, "1", 101, 60, None, "A", "I")],
        "sample string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual string",
    )
    sites = spark.createDataFrame(
        [("snp", "1", 103, "G", "T"), ("gap", "1", 105, "A", "C"), ("del", "1", 104, "TAC", "T"), ("ins", "1", 104, "T", "TTTT")],
        "snp string, chrom string, pos int, ref string, alt string",
    )
    got = sorted((r.snp, r.allele, r.bq) for r in dense.observed_alleles(reads, sites, 3).collect())
    want = [("snp", 0, 40), ("snp", 0, 20), ("snp", 0, 40), ("snp", 0, 40), ("snp", 1 if "ACGTACGT"[5] == "T" else 2, 40)]
    want += [("gap", 0, 40), ("gap", 2, 40), ("gap", 0, 40), ("gap", 2, 40)]  # none of the read with a deletion there
    # spanning reads: as the reference, the deletion, insertions of three and two; one that ends at 105 does not span
    want += [("del", 0, 60), ("del", 1, 60), ("del", 2, 30), ("del", 2, 30), ("del", 2, 20)]
    want += [("ins", 0, 90), ("ins", 2, 30), ("ins", 1, 90), ("ins", 2, 90), ("ins", 0, 90)]
    for name in ("snp", "del", "ins"):
        assert sorted(g for g in got if g[0] == name) == sorted(w for w in want if w[0] == name), name
    assert len([g for g in got if g[0] == "gap"]) == 4


def test_dense_flow(spark):
    rnd = random.Random(6)
    truth = {(s, k): rnd.choice([0, 1, 2]) for s in range(12) for k in range(8)}
    rows = []
    for (s, k), g in truth.items():
        if s == 11 and k % 2:
            continue  # cells without reads
        for _ in range(30):
            alt = rnd.random() < (0.002, 0.5, 0.998)[g]
            rows.append((f"s{s}", 0, "1", 1000 * k + 95, 60, "11M", "AAAAA" + ("C" if alt else "A") + "AAAAA", "I" * 11))
    rows.append(("stranger", 0, "1", 95, 60, "11M", "A" * 11, "I" * 11))
    reads = spark.createDataFrame(rows, "sample string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual string")
    sites = spark.createDataFrame([(k, "1", 1000 * k + 100, "A", "C") for k in range(8)] + [(99, "3", 5, "A", "C")], "snp int, chrom string, pos int, ref string, alt string")
    samples = spark.createDataFrame([(f"s{s}", None if s % 2 else 0.02) for s in range(12)], "sample string, contamination double")
    calls, stats = dense.dense_genotypes(reads, sites, samples)
    got = {(r["sample"], r.snp): r for r in calls.collect()}
    assert len(got) == 12 * 8 - 4
    assert all(r.gt == truth[int(s[1:]), k] and r.dp == 30 for (s, k), r in got.items())
    by = {r.snp: r for r in stats.collect()}
    assert sorted(by) == list(range(8))
    for k, r in by.items():
        held = [truth[s, k] for s in range(12 if k % 2 == 0 else 11)]
        assert abs(r.af - sum(held) / (2 * len(held))) < 0.02 and r.n_with_reads == len(held)
