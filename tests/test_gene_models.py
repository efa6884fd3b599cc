"""Molecules over gene models against plain sets."""

import random
from collections import defaultdict

import pytest

from strandline.operators import genes

FRAGMENT = "cell int, umi long, chrom string, strand string, beg int, end int"
ELEMENT = "chrom string, strand string, beg int, end int, type string, transcript_id string, gene_id string"


def plain(fragments, elements, unique_bin, whole):
    exons = {(c, s, b, e, t, g) for c, s, b, e, kind, t, g in elements if kind == "exon" and t}
    middle = defaultdict(list)
    for c, _, b, e, _, _, g in elements:
        middle[g, c] += [b, e]
    counts, molecules = defaultdict(set), defaultdict(set)
    for cell, umi, *at in set(fragments):
        molecules[cell, umi].add(tuple(at))
    for m, own in molecules.items():
        hits = [(x, y) for x in own for y in exons if x[:2] == y[:2] and x[2] <= y[3] and y[2] <= x[3]]
        if whole:
            hits = [h for h in hits if {x for x, y in hits if y[4] == h[1][4]} == own]
        bins = defaultdict(list)
        for _, (c, s, b, e, t, g) in hits:
            counts["exon", f"{t}:{c}:{b}-{e}", m[0]].add(m)
            counts["transcript", t, m[0]].add(m)
            for (name, chrom), ends in middle.items():
                if g and name == g:
                    bins[chrom, int((min(ends) + max(ends)) / (unique_bin // 2))].append(g)
        for found in bins.values():
            counts["gene", min(found), m[0]].add(m)
    return sorted((*k, len(v)) for k, v in counts.items())


@pytest.mark.parametrize("whole", [False, True])
def test_against_sets(spark, whole):
    rng = random.Random(5)
    spot = lambda size: (rng.choice("12"), rng.choice("+-"), b := rng.randrange(60), b + rng.randrange(size))
    fragments = [(rng.randrange(2), rng.randrange(25), *spot(12)) for _ in range(130)]
    elements = [(*spot(15), rng.choice(["exon", "exon", "gene"]), rng.choice(["t1", "t2", "t3", None]), rng.choice(["a", "b", "c", None])) for _ in range(60)]
    elements += [("1", s, 10, 30, "exon", "t4", "d") for s in "+-"]  # one name on both strands
    fragments += [(0, 99, "1", s, 12, 15) for s in "+-"]
    got = genes.element_umis(spark.createDataFrame(fragments, FRAGMENT), spark.createDataFrame(elements, ELEMENT), 40, whole, 16)
    assert sorted(map(tuple, got.collect())) == plain(fragments, elements, 40, whole)


def test_pairs_do_not_grow_with_like_stretches(spark, monkeypatch):
    """A thousand molecules that lie alike meet four hundred exons as one row."""
    made, join = [], genes.overlap_join
    monkeypatch.setattr(genes, "overlap_join", lambda *a, **k: made.append(join(*a, **k)) or made[-1])
    fragments = spark.range(1000).selectExpr("1 as cell", "id as umi", "'1' as chrom", "'+' as strand", "500 as beg", "520 as end")
    elements = spark.range(400).selectExpr("'1' as chrom", "'+' as strand", "cast(101 + id as int) as beg", "cast(510 + id as int) as end", "'exon' as type", "'t' as transcript_id", "'g' as gene_id")
    got = genes.element_umis(fragments, elements)
    assert {r.umis for r in got.collect()} == {1000}
    assert sum(x.count() for x in made) <= 400
