"""Packed files: what is written comes back, and broken ones are refused."""

import struct

import pytest
from pyspark.sql import functions as F

from strandline.sources import binary, packed, profiles, sinks, text

READS = [
    {"qname": "r1", "flag": 99, "chrom": "1", "pos": 100, "mapq": 60, "cigar": "5S10M2D5M", "rnext": "=", "pnext": 300, "tlen": 220, "seq": "ACGTN" * 4, "qual": "I" * 20,
     "tags": [("NH", "1"), ("XF", "0.5"), ("RG", "a b"), ("XA", "7"), ("XC", "c"), ("XB", "i,1,-2,3")], "tag_types": [("NH", "i"), ("XF", "f"), ("RG", "Z"), ("XA", "Z"), ("XC", "A"), ("XB", "B")]},
    {"qname": "r2", "flag": 4, "chrom": None, "pos": 0, "mapq": 0, "cigar": None, "rnext": None, "pnext": 0, "tlen": 0, "seq": "ACG", "qual": None, "tags": [], "tag_types": []},
    {"qname": "r3", "flag": 0, "chrom": "2", "pos": 7, "mapq": 1, "cigar": "3M", "rnext": "1", "pnext": 9, "tlen": 0, "seq": "TTT", "qual": "!!!", "tags": [], "tag_types": []},
]
VARIANTS = [
    {"chrom": "2", "pos": 5, "id": "rs1", "ref": "A", "alts": ["G", "T"], "qual": 9.5, "filters": ["PASS"], "info": [("AF", "0.1,0.2"), ("DB", "")],
     "samples": [("s1", [("GT", "0/1"), ("DP", "12")]), ("s2", [("GT", "1|2"), ("DP", ".")])]},
    {"chrom": "1", "pos": 9, "id": None, "ref": "ACGTACGTACGTACGTACGT", "alts": ["A"], "qual": None, "filters": [], "info": [], "samples": [("s1", [("GT", "./."), ("DP", "3")]), ("s2", [("GT", "1"), ("DP", "4")])]},
]


def test_alignments():
    data = packed.encode_alignments(READS, ["1", "2"])
    assert list(packed.decode_alignments(data)) == READS
    with pytest.raises(ValueError):
        list(packed.decode_alignments(packed.blocked(b"BAM\2")))
    with pytest.raises(ValueError):
        list(packed.decode_alignments(b"BAM\1" + struct.pack("<i", 50)))


def test_variants():
    data = packed.encode_variants(VARIANTS, ["1", "2"], ["s1", "s2"], ["LOW"], ["AF", "DB"], ["GT", "DP"])
    got = list(packed.decode_variants(data))
    assert [dict(r, samples=[(s, list(c)) for s, c in r["samples"]]) for r in got] == VARIANTS
    with pytest.raises(ValueError):
        list(packed.decode_variants(b"VCF"))


def test_files(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(packed.encode_alignments(READS, ["1", "2"]))
    (tmp_path / "a.bcf").write_bytes(packed.encode_variants(VARIANTS, ["1", "2"], ["s1", "s2"], [], ["AF", "DB"], ["GT", "DP"]))
    r = {x.qname: x for x in packed.read_alignments(spark, f"{tmp_path}/a.bam").collect()}
    assert r["r1"].tags["XB"] == "i,1,-2,3" and r["r3"].rnext == "1" and r["r2"].chrom is None
    # the same reads as text
    sinks.write_sam(packed.read_alignments(spark, f"{tmp_path}/a.bam"), f"{tmp_path}/sam", ["@HD\tVN:1.6"])
    back = {x.qname: x for x in text.read_reads(spark, f"{tmp_path}/sam").collect()}
    for name, x in r.items():
        assert {c: back[name][c] for c in x.asDict()} == x.asDict()
    v = {x.pos: x for x in packed.read_packed_variants(spark, f"{tmp_path}/a.bcf").collect()}
    assert v[5].info == {"AF": "0.1,0.2", "DB": ""} and v[5].samples[1].fields["GT"] == "1|2"


def test_repeated_keys_keep_the_first(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t1\t.\tA\tC\t.\t.\tDP=1;DP=2;X\n")
    assert text.read_variants(spark, f"{tmp_path}/a.vcf").first().info == {"DP": "1", "X": ""}


def test_haplotype_blocks_round_trip(spark, tmp_path):
    alleles = {(10, 0): 0, (10, 1): 1, (10, 2): 1, (20, 0): 1, (20, 1): 0, (20, 2): 0, (30, 0): 1, (30, 1): 1, (30, 2): 0}
    rows = spark.createDataFrame([("1", p, "A", "C", h, a) for (p, h), a in alleles.items()], "chrom string, pos int, ref string, alt string, haplotype int, allele int")
    binary.write_haplotype_blocks(rows, f"{tmp_path}/h", 2)
    blocks = binary.read_haplotype_blocks(spark, f"{tmp_path}/h")
    assert sorted((r.block, r.n_reps) for r in blocks.collect()) == [(0, 2), (1, 2)]
    got = {(r.pos, r.haplotype): r.allele for r in binary.haplotype_alleles(blocks, [0, 1, 2]).collect()}
    assert got == alleles


def test_dense_matrix_is_thinned(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("gene\tA\tB\n" + "".join(f"g{i}\t100\t0\n" for i in range(200)))
    assert profiles.read_dense_matrix(spark, f"{tmp_path}/m.tsv").agg(F.sum("umis")).first()[0] == 20_000
    half = profiles.read_dense_matrix(spark, f"{tmp_path}/m.tsv", 0.5)
    assert abs(half.agg(F.sum("umis")).first()[0] - 10_000) < 400
