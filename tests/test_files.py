"""Readers, writers and commands on small files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.__main__ import main
from strandline.sources import binary, sinks, text

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="af">
##FORMAT=<ID=GT,Number=1,Type=String,Description="gt">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="dp">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	A	B	C
1	100	rs1	A	G	50	PASS	AF=0.5;DB	GT:DP	0/1:10	1|1:20	./.:.
1	200	.	C	T	.	LOW;X	.	GT:DP	0/0:5	0/1:6	1/1:7
2	50	rs3	G	A	9.5	PASS	AF=0.1	GT:DP	1/1:9	0/0:9	.
"""
SAM = "@HD\tVN:1.6\n" + "".join(
    f"r{i}\t0\t1\t91\t60\t5S5M2D10M\t*\t0\t0\t{'N' * 5}{'ACGTA'}{'C' * 2}{b}{'C' * 7}\t{'I' * 20}\tCB:Z:c{i % 2}\tUB:Z:u{i}\tNH:i:1\tRG:Z:a\n" for i, b in enumerate("AGAA")
)


@pytest.fixture()
def files(tmp_path):
    for name, body in {
        "a.vcf": VCF, "a.sam": SAM, "a.ped": "F1 A,B 0 0 1\nF1 C 0 0 2\nF1 K A C 1\n", "a.sex": "A 1\nB 2\nC 0\n", "a.bed": "1\t9\t20\n1\t15\t30\n",
        "a.fa": ">c1 x\nACGT\nNNGC\n>c2\nAAAA\n", "a.fq": "@r1\nACGTACGTACGTAA\n+\nIIIIIIIIIIIIII\n@r2\nACGTACGTACGTCC\n+\n@IIIIIIIIIIIII\n", "ids": "rs3\n",
        "a.gtf": '1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t"; gene_name "N";\n1\tx\tCDS\t13\t18\t.\t+\t0\tgene_id "g"; transcript_id "t";\n1\tx\texon\t31\t40\t.\t+\t.\tgene_id "g"; transcript_id "t";\n',
        "rg": "k a b\n",
    }.items():
        (tmp_path / name).write_text(body)
    return tmp_path


def run(spark, files, *args):
    out = f"{files}/out"
    assert main([*args, "--out", out], spark) == 0
    return [r.asDict() for r in spark.read.csv(out, sep="\t", header=True).collect()]


def test_vcf(spark, files):
    v = {r.pos: r for r in text.read_variants(spark, f"{files}/a.vcf").collect()}
    assert v[100].info == {"AF": "0.5", "DB": ""} and v[200].qual is None and v[200].filters == ["LOW", "X"] and v[200].id is None
    g = {(r.pos, r.sample): r for r in text.read_genotypes(spark, f"{files}/a.vcf").collect()}
    assert g[100, "B"].phased and (g[100, "B"].a1, g[100, "B"].a2, g[100, "B"].dp) == (1, 1, 20)
    assert g[100, "C"].a1 is None and g[2 * 25, "C"].a1 is None and len(g) == 9
    out = f"{files}/w"
    sinks.write_vcf(text.read_variants(spark, f"{files}/a.vcf"), out, [], text.read_genotypes(spark, f"{files}/a.vcf"), ["A", "B", "C"], ("GT", "DP"))
    back = [r.pos for r in text.read_variants(spark, out).orderBy("chrom", "pos").collect()]
    assert back == [100, 200, 50] and text.vcf_samples(spark, out) == ["A", "B", "C"]
    assert {(r.pos, r.sample): r.dp for r in text.read_genotypes(spark, out).collect()} == {k: r.dp for k, r in g.items()}


def test_small_formats(spark, files):
    assert [(r.beg, r.end) for r in text.read_bed(spark, f"{files}/a.bed").collect()] == [(10, 20), (16, 30)]
    ped = text.read_ped(spark, f"{files}/a.ped")
    assert [tuple(r) for r in text.trios(ped).collect()] == [("A", "C", "K")] and [tuple(r) for r in text.duplicates(ped).collect()] == [("A", "B")]
    assert {r.sample: r.male for r in text.read_sex_map(spark, f"{files}/a.sex").collect()} == {"A": True, "B": False, "C": False}
    assert {r.chrom: r.seq for r in text.read_fasta(spark, f"{files}/a.fa").collect()} == {"c1": "ACGTNNGC", "c2": "AAAA"}
    assert sorted(r.barcode for r in text.read_fastq(spark, f"{files}/a.fq", 12).collect()) == ["ACGTACGTACGT"] * 2
    r = sinks.gene_predictions(text.read_gtf(spark, f"{files}/a.gtf")).collect()[0]
    assert (r.tx_start, r.tx_end, r.cds_start, r.cds_end, r.exon_starts, r.exon_ends) == (10, 40, 12, 18, "10,30,", "20,40,")
    made = text.with_missing_parents(text.read_gtf(spark, f"{files}/a.gtf")).filter("type in ('gene', 'transcript')")
    assert {(r.type, r.beg, r.end) for r in made.collect()} == {("gene", 11, 40), ("transcript", 11, 40)}


def test_pileup_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, "AC", 3, 3, 3, 2)], text.PILEUP_TYPES["cel"])
    snps = spark.createDataFrame([(0, "1", 10, "A", "G", 0.5), (1, "1", 20, "C", "T", 0.25)], text.PILEUP_TYPES["var"])
    bases = spark.createDataFrame([(0, 0, 1, 0, 30), (0, 0, 2, 1, 20), (0, 1, 1, 2, 50)], "cell int, snp int, umi int, allele int, bq int")
    sinks.write_pileup(cells, snps, bases, f"{tmp_path}/p")
    c, s, b = text.read_pileup(spark, f"{tmp_path}/p")
    assert c.count() == 1 and [r.af for r in s.orderBy("snp").collect()] == [0.5, 0.25]
    assert sorted((r.snp, r.allele, r.bq) for r in b.collect()) == [(0, 0, 30), (0, 1, 20), (1, 2, 40)]
    with pytest.raises(ValueError):
        text.read_pileup_table(spark, f"{tmp_path}/p.cel.gz", "var")


def test_matrix_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (2, 2, 3)], "gene int, cell int, umis int")
    sinks.write_matrix(counts, spark.createDataFrame([(1, "A"), (2, "B")], "cell int, barcode string"), spark.createDataFrame([(1, "g1", "x"), (2, "g2", "y")], "gene int, gene_id string, symbol string"), str(tmp_path))
    c, b, g = text.read_matrix(spark, str(tmp_path))
    assert sorted(map(tuple, c.collect())) == [(1, 1, 5), (2, 1, 1), (2, 2, 3)]
    assert [r.barcode for r in b.orderBy("cell").collect()] == ["A", "B"] and [r.symbol for r in g.orderBy("gene").collect()] == ["x", "y"]


def test_bgen(spark, tmp_path):
    def s(form, t):
        return struct.pack(form, len(t)) + t.encode()

    def block(rows):
        body = struct.pack("<IHBB", len(rows), 2, 2, 2) + bytes(2 | (128 if r is None else 0) for r in rows) + bytes([0, 8])
        body += b"".join(bytes(r or (0, 0)) for r in rows)
        z = zlib.compress(body)
        return struct.pack("<II", len(z) + 4, len(body)) + z

    rows = [[(255, 0), (0, 255), None], [(0, 0), (128, 127), (255, 0)]]
    data = struct.pack("<IIII4sI", 20, 20, 2, 3, b"bgen", 1 | 2 << 2)
    for i, r in enumerate(rows):
        data += s("<H", f"v{i}") + s("<H", f"rs{i}") + s("<H", "1") + struct.pack("<IH", 100 + i, 2) + s("<I", "A") + s("<I", "G") + block(r)
    (tmp_path / "x.bgen").write_bytes(data)
    out = binary.read_bgen(spark, f"{tmp_path}/x.bgen").orderBy("pos").collect()
    assert [(r.rsid, r.pos, r.ref, r.alt) for r in out] == [("rs0", 100, "A", "G"), ("rs1", 101, "A", "G")]
    assert out[0].gp == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], None] and abs(out[1].gp[0][2] - 1) < 1e-6
    assert binary.read_bgen(spark, f"{tmp_path}/x.bgen", 1, 1).count() == 1


def test_haplotype_blocks():
    lines = ["##x", "#CHROM", "1\t1\t.\t.\t.\t.\t.\tVARIANTS=2;REPS=3\tGT\t0|1\t2|2", "1\t10\ta\tA\tC\t.\t.\t.\t1,1", "1\t20\tb\tG\tT\t.\t.\t.\t0"]
    block = next(binary.parse_haplotype_blocks(lines))
    assert [a for _, a in binary.block_haplotypes(block)] == [[0, 1, 1, 1], [1, 0, 0, 0]]
    part = binary.subset_block(block, [0, 2])
    assert part["n_reps"] == 2 and [a for _, a in binary.block_haplotypes(part)] == [[0, 1], [1, 0]]


def test_commands(spark, files):
    f = f"{files}"
    got = {r["sample"]: r for r in run(spark, files, "vcf-sample-summary", "--vcf", f"{f}/a.vcf")}
    assert (got["A"]["REF"], got["A"]["HET"], got["A"]["ALT"], got["C"]["MISS"]) == ("1", "1", "1", "2")
    got = run(spark, files, "vcf-sample-summary", "--vcf", f"{f}/a.vcf", "--include-expr", "QUAL > 20")
    assert {r["ALL"] for r in got} == {"1"}
    assert {r["snp"]: r["ac"] for r in run(spark, files, "vcf-update-info", "--vcf", f"{f}/a.vcf")} == {"1:100:A:G": "3", "1:200:C:T": "3", "2:50:G:A": "2"}
    assert [r["pos"] for r in run(spark, files, "vcf-extract", "--vcf", f"{f}/a.vcf", "--ids", f"{f}/ids")] == ["50"]
    assert len(run(spark, files, "vcf-ibs-matrix", "--list", f"{f}/a.vcf", "--ref", f"{f}/a.vcf")) == 9  # all share site 200
    assert run(spark, files, "cram-flagstat-all", "--sam", f"{f}/a.sam") == [{"mask": "0", "masked": "0", "reads": "4"}]
    assert {r["rg"] for r in run(spark, files, "cram-update-rg", "--sam", f"{f}/a.sam", "--rg-map", f"{f}/rg")} == {"k"}
    plp = run(spark, files, "dsc-pileup", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf")
    # position 100: five aligned, two deleted, the third base after; reads r0 A, r1 G, r2 A, r3 A
    assert {(r["cell"], r["alleles"]) for r in plp} == {("c0", "00"), ("c1", "10")}
    calls = run(spark, files, "demultiplex", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf")
    assert {r["cell"] for r in calls} == {"c0", "c1"}
    assert [r["gc"] for r in run(spark, files, "fasta-gc-content", "--fasta", f"{f}/a.fa", "--window", "4", "--step", "2") if r["chrom"] == "c1"] == ["2", "2", "2", "4"]
    assert len(run(spark, files, "gtf-util", "--gtf", f"{f}/a.gtf")) == 1
    assert len(run(spark, files, "sc-map-stamps", "--fastq", f"{f}/a.fq")) == 4
    assert len(run(spark, files, "vcf-svd", "--vcf", f"{f}/a.vcf", "--max-pc", "2")) == 3
    assert {r["sample"] for r in run(spark, files, "vcf-infer-ancestry", "--vcf", f"{f}/a.vcf", "--model-vcf", f"{f}/a.vcf", "--max-pc", "1")} == {"A", "B", "C"}


def test_more_commands(spark, files):
    f = f"{files}"
    (files / "pairs").write_text("c0\tc1\n")
    mixed = run(spark, files, "mix-barcodes", "--sam", f"{f}/a.sam", "--pairs", f"{f}/pairs")
    assert {r["barcode"] for r in mixed} <= {"c0.c1", "c1.c0"} and len(mixed) == 4
    assert run(spark, files, "procap-ends", "--sam", f"{f}/a.sam") == [{"chrom": "1", "fwd": "true", "five": "91", "umis": "4", "reads": "4"}]
    (files / "b.gtf").write_text('1\tx\texon\t95\t99\t.\t+\t.\tgene_id "g"; transcript_id "t";\n1\tx\texon\t95\t99\t.\t-\t.\tgene_id "h"; transcript_id "u";\n')
    assert {(r["cell"], r["gene"], r["umis"]) for r in run(spark, files, "make-dge", "--sam", f"{f}/a.sam", "--gtf", f"{f}/b.gtf")} == {("c0", "g", "2"), ("c1", "g", "2")}
    got = run(spark, files, "sam-genotype", "--sam", f"{f}/a.sam", "--vcf", f"{f}/a.vcf")
    assert [(r["sample"], r["ad0"], r["ad1"]) for r in got] == [("a", "3", "1")] and got[0]["pl1"] == "0"
    both = f"{f}/a.vcf,{f}/a.vcf"
    assert len(run(spark, files, "vcf-paste-calls", "--vcfs", both)) == 18
    found = {r["snp"]: r for r in run(spark, files, "vcf-merge-candidate-variants", "--vcfs", both)}
    assert found["1:100:A:G"]["n_samples"] == "4" and found["1:100:A:G"]["qual"] == "50.0" and len(found) == 3
    assert {r["snp"] for r in run(spark, files, "vcf-site-filter", "--vcf", f"{f}/a.vcf", "--min-call-rate", "0.9")} == {"1:200:C:T"}
