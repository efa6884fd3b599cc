"""Overlaps whose work must not grow with the number of overlapping pairs."""

from strandline.operators import genotyping, intervals

SPAN = "chrom int, beg int, end int"


def test_overlapping_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (1, 40, 50), (2, 5, 9), (None, 5, 9)], SPAN)
    right = spark.createDataFrame([(1, 9, 12), (1, 1, 5), (1, 1, 3), (1, 51, 60), (3, 1, 99)], SPAN)
    got = intervals.overlapping(left, right, ["chrom"], 8)
    assert got.columns == left.columns
    assert sorted(map(tuple, got.collect())) == [(1, 5, 9), (1, 5, 9)]


def test_names_met_once_for_many_intervals(spark):
    left = spark.createDataFrame([(7, 1, 10, 12), (8, 1, 200, 210)], f"id int, {SPAN}")
    right = spark.createDataFrame([(1, 1, 100 + i % 3, "a") for i in range(500)] + [(1, 12, 12, "b"), (1, 13, 13, "c")], f"{SPAN}, gene string")
    got = intervals.overlapped_names(left, right, ["chrom"], ["gene"], 1000)
    assert [(r.id, [x.gene for x in r.met]) for r in got.collect()] == [(7, ["a", "b"])]


def test_gene_hits_of_fragments_in_several_bins(spark):
    own = f"cell int, umi int, strand string, {SPAN}"
    fragments = spark.createDataFrame([(1, 1, "+", 1, 1, 40), (1, 1, "+", 1, 30, 35), (1, 2, "-", 1, 1, 40), (2, 1, "+", 1, 90, 99)], own)
    exons = spark.createDataFrame([("exon", "+", "g1", 1, 8, 33), ("exon", "+", "g1", 1, 30, 60), ("exon", "-", "g2", 1, 40, 41), ("gene", "+", "g3", 1, 1, 99)], f"type string, strand string, gene_id string, {SPAN}")
    got = genotyping.gene_hits(fragments, exons, width=8)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "g1"), (1, 2, "g2")]
