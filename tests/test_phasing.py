"""Phasing of joined blocks, and communities at all levels."""

import itertools

import numpy as np
import pytest

from strandline.operators import clustering, kernels, phasing

SCHEMA = "sample int, snp int, code int"


def panel_of(haps, pairs):
    return [(s, k, int(haps[a][k] + haps[b][k]) + 1) for s, (a, b) in enumerate(pairs) for k in range(len(haps[0]))]


def test_em_equals_the_row_wise_one():
    rng = np.random.default_rng(4)
    genotypes = rng.integers(0, 3, (60, 5))
    codes = ((genotypes + 1) << 2 * np.arange(5)).sum(axis=1)
    patterns, counts = np.unique(codes, return_counts=True)
    freq, best = phasing.haplotype_em(patterns, counts.astype(float), rounds=6, enough=0)
    assert np.allclose(freq[:32], kernels.phase_counts(genotypes, 6, 0)) and freq[32:].sum() == 0
    for p, one, two in zip(best["pattern"], best["one"], best["two"]):
        assert all((one >> k & 1) + (two >> k & 1) + 1 == p >> 2 * k & 3 for k in range(5))


@pytest.mark.parametrize("size,overlap", [(4, 2), (6, 3), (8, 4), (5, 1)])
def test_chains_follow_founders(spark, size, overlap):
    """Samples of four founder haplotypes: every phase set is right over all its blocks."""
    rng = np.random.default_rng(size)
    haps = rng.integers(0, 2, (4, 37))
    pairs = [tuple(rng.integers(0, 4, 2)) for _ in range(60)] + [(a, a) for a in range(4)] * 5
    rows = spark.createDataFrame(panel_of(haps, pairs), SCHEMA).repartition(4)
    out = phasing.phased(rows, size, overlap).toPandas()
    assert len(out) == len(pairs) * 37
    assert (out["a1"] + out["a2"] + 1 == out["code"]).all()
    right = n = joined = 0
    for (s, _), part in out.groupby(["sample", "phase_set"]):
        het = part[part["code"] == 2].sort_values("snp")
        if len(het) < 2:
            continue
        a, b = pairs[s]
        own = (het["a1"].to_numpy() == haps[a][het["snp"]]).astype(int)
        right += max(own.sum(), len(own) - own.sum())
        n += len(own)
        joined += het["snp"].max() - het["snp"].min() >= size
    assert right / n > 0.95 and joined > 10


def test_turns_multiply_over_blocks(spark):
    # blocks of two sites that share one: heterozygous throughout, each pair written with the smaller haplotype first
    rows = [(1, b, o, 3 ^ o, 1.0) for b, o in enumerate((0, 1, 0, 1, 1))] + [(1, 9, 0, 3, 1.0), (2, 0, 0, 1, 1.0), (2, 1, 0, 2, 1.0)]
    got = {(r.sample, r.block): (r.one, r.phase_set) for r in phasing.joined_blocks(spark.createDataFrame(rows, "sample int, block long, one int, two int, p double"), 2, 1).collect()}
    walk, last = {}, None
    for b, o in enumerate((0, 1, 0, 1, 1)):
        one = o if last is None or (last >> 1 & 1) == (o & 1) else 3 ^ o
        walk[b], last = one, one
    assert [got[1, b][0] for b in range(5)] == [walk[b] for b in range(5)] and {got[1, b][1] for b in range(5)} == {0}
    assert got[1, 9] == (0, 9) and got[2, 0][1] == 0 and got[2, 1][1] == 1  # a gap, and a site that is not heterozygous


def test_phasing_of_awkward_panels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phasing.phased(empty, 4, 2).count() == 0
    rows = [(1, 0, 2), (1, 0, 2), (1, 1, 2), (1, 2, 0), (2, 0, 3), (2, 1, 1), (2, 2, 2), (None, 0, 1), (3, 1, 2)]
    got = {(r.sample, r.snp): (r.code, r.a1, r.a2, r.phase_set) for r in phasing.phased(spark.createDataFrame(rows, SCHEMA), 4, 2).collect()}
    assert (1, 2) not in got and got[2, 0][:3] == (3, 1, 1) and got[3, 1] == (2, None, None, None) and len(got) == 7
    with pytest.raises(ValueError):
        phasing.phased(empty, 4, 3)


def quality(edges, group):
    m2 = 2 * sum(w for *_, w in edges)
    inside = sum(2 * w for a, b, w in edges if group[a] == group[b])
    tot = {}
    for a, b, w in edges:
        tot[group[a]] = tot.get(group[a], 0) + w
        tot[group[b]] = tot.get(group[b], 0) + w
    return inside / m2 - sum(t * t for t in tot.values()) / m2**2


def test_levels_of_a_ring_of_cliques(spark):
    """Twelve cliques of five in a ring: later levels join what the first one left apart, and end at the cliques."""
    edges = [(5 * q + a, 5 * q + b, 1.0) for q in range(12) for a, b in itertools.combinations(range(5), 2)]
    edges += [(5 * q, (5 * q + 5) % 60 + 1, 1.0) for q in range(12)]
    table = spark.createDataFrame(edges, "a int, b int, w double")
    out = clustering.community_levels(table, rounds=4).toPandas()
    levels = [dict(zip(p["node"], p["community"])) for _, p in out.groupby("level")]
    values = [quality(edges, g) for g in levels]
    assert len(levels) >= 2 and all(len(g) == 60 for g in levels) and all(a < b for a, b in zip(values, values[1:]))
    assert len(set(levels[-1].values())) < len(set(levels[0].values())) and set(levels[-1].values()) and all(len({levels[-1][5 * q + a] for a in range(5)}) == 1 for q in range(12))
    for low, high in zip(levels, levels[1:]):  # communities are joined, never split
        assert len({(low[n], high[n]) for n in low}) == len(set(low.values()))
    groups = spark.createDataFrame([(n, int(g)) for n, g in levels[-1].items()], "node int, community int")
    row = clustering.modularity(table, groups).first()
    assert row.modularity == pytest.approx(values[-1]) and row.weight == 132 and row.n_groups == len(set(levels[-1].values()))


def test_modularity_with_loops_and_lone_nodes(spark):
    edges = [(1, 1, 2.0), (1, 2, 1.0), (2, 3, 4.0), (4, 4, 1.0), (2, 1, 0.5)]
    table = spark.createDataFrame(edges, "a int, b int, w double")
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 3)], "node int, community int")
    row = clustering.modularity(table, groups).first()
    assert row.modularity == pytest.approx(quality(edges, {1: 7, 2: 7, 3: 3, 4: 4})) and row.n_groups == 3
    none = spark.createDataFrame([], "a int, b int, w double")
    assert clustering.modularity(none, groups).first().modularity is None and clustering.community_levels(none).count() == 0
    alone = clustering.community_levels(spark.createDataFrame([(1, 1, 1.0)], "a int, b int, w double")).collect()
    assert [tuple(r) for r in alone] == [(1, 1, 1)]
