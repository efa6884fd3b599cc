"""Splittable block-compressed files: every record once, only the chunks of an interval, all or nothing when writing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import bgzf, packed, sinks, text

CHROMS = [str(i) for i in range(1, 6)]


def reads(spark, n=6000, longest=400):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        size = rnd.choice([20, 50, longest])
        cigar = rnd.choice([f"{size}M", f"5S{size - 10}M5S", f"{size - 5}M40D5M", None])
        chrom = rnd.choice([*CHROMS, None]) if cigar else rnd.choice(CHROMS)
        rows.append((f"r{i}", 4 if chrom is None else 0, chrom, rnd.randint(1, 400_000) if chrom else 0, 60, cigar, "=", 5, 7,
                     "".join(rnd.choice("ACGT") for _ in range(size)), None, {"NM": str(i % 7), "XS": "a" * rnd.randint(0, 60)}, {"NM": "i", "XS": "Z"}))
    return spark.createDataFrame(rows, packed.READS_SQL).repartition(3)


def shown(df, *columns):
    cols = columns or ("qname", "chrom", "pos", "cigar", "seq")
    return sorted(map(str, df.select(*cols).collect()))


@pytest.fixture(scope="module")
def bam(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    rows = reads(spark).cache()
    bgzf.write_alignments(rows, path, CHROMS, files=2)
    return rows, path


def one_file(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".bam", ".bcf", ".gz")))[0]


@pytest.mark.parametrize("split", [1 << 30, 50_000, 7_001, 700])
def test_every_record_once_at_any_split(spark, bam, split):
    rows, path = bam
    got = bgzf.read_alignments(spark, path, split=split)
    assert shown(got) == shown(rows)
    if split == 50_000:
        report = bgzf.scan_report(spark, "bgzf_alignments", path, split=split).collect()
        assert len(report) > 4 and sum(r.records > 0 for r in report) > 4


def test_files_are_whole(spark, bam):
    rows, path = bam
    assert shown(packed.read_alignments(spark, f"{path}/*.bam")) == shown(rows)
    assert {os.path.splitext(f)[1] for f in os.listdir(path) if not f.startswith((".", "_"))} == {".bam", ".csi"}
    with open(one_file(path), "rb") as f:
        assert f.read().endswith(packed.END_OF_BLOCKS)


def overlapping(rows, chrom, beg, end):
    size = F.coalesce(F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MD]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0))
    return rows.filter((F.col("chrom") == chrom) & (F.col("pos") <= end) & (F.col("pos") + F.greatest(size, F.lit(1)) - 1 >= beg))


@pytest.mark.parametrize("region", [("2", 1, 20_000), ("3", 200_000, 200_050), ("5", 399_000, 1 << 29), ("1", 1, 1 << 29), ("4", 16384, 16385), ("9", 1, 50)])
def test_regions_read_their_chunks(spark, bam, region):
    rows, path = bam
    chrom, beg, end = region
    said = f"{chrom}:{beg}-{end}"
    want = shown(overlapping(rows, *region))
    assert shown(bgzf.read_alignments(spark, path, said)) == want
    report = bgzf.scan_report(spark, "bgzf_alignments", path, said).collect()
    assert sum(r.kept for r in report) == len(want)
    if end - beg < 30_000 and report:
        whole = rows.count()
        assert sum(r.records for r in report) < whole / 8
        assert sum(r.bytes for r in report) < 4 * bgzf.FETCH_BYTES * max(1, len(report))


def test_regions_without_an_index_are_a_filter(spark, bam, tmp_path):
    rows, path = bam
    for i, f in enumerate(sorted(f for f in os.listdir(path) if f.endswith(".bam"))):
        os.symlink(os.path.join(path, f), tmp_path / f"{i}.bam")
    got = bgzf.read_alignments(spark, str(tmp_path), "2:1-20000;3", split=20_000)
    assert shown(got) == sorted(shown(overlapping(rows, "2", 1, 20_000)) + shown(overlapping(rows, "3", 1, 1 << 29)))


def test_an_index_divides_long_chunks(spark, bam):
    rows, path = bam
    report = bgzf.scan_report(spark, "bgzf_alignments", path, "1", split=10_000).collect()
    assert len(report) > 3 and sum(r.kept for r in report) == rows.filter("chrom = '1'").count()


def test_pushed_conditions(spark, bam):
    rows, path = bam
    got = bgzf.read_alignments(spark, path).filter("chrom = '2' AND pos >= 1000 AND pos < 9000")
    assert shown(got) == shown(rows.filter("chrom = '2' AND pos >= 1000 AND pos < 9000"))
    reader = bgzf.Reader(bgzf.Alignments, {"path": path})
    whole = len(reader.partitions())
    kept = reader.pushFilters([bgzf.EqualTo(("chrom",), "2"), bgzf.LessThan(("pos",), 9000)])
    chosen = bgzf.planned(bgzf.Alignments, bgzf.listed(path, (".bam",)), [bgzf.Region("2", 1, 8999)], bgzf.SPLIT_BYTES)
    assert len(list(kept)) == 2 and whole == 2 and reader.partitions() == chosen


def test_records_longer_than_blocks(spark, tmp_path):
    rows = reads(spark, 40, longest=200_000)
    bgzf.write_alignments(rows, str(tmp_path / "long"), CHROMS, files=1)
    for split in (1 << 30, 30_000):
        assert shown(bgzf.read_alignments(spark, str(tmp_path / "long"), split=split)) == shown(rows)


def test_records_that_do_not_begin_with_blocks(spark, tmp_path):
    rows = reads(spark, 3000).collect()
    data = packed.encode_alignments([r.asDict() for r in rows], CHROMS)  # blocks cut anywhere
    (tmp_path / "plain.bam").write_bytes(data)
    for split in (9_973, 1 << 20):
        got = bgzf.read_alignments(spark, str(tmp_path / "plain.bam"), split=split)
        assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in rows)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = reads(spark, 300)
    broken = rows.withColumn("cigar", F.when(F.col("qname") == "r77", "5?").otherwise(F.col("cigar")))
    path = tmp_path / "failed"
    with pytest.raises(Exception):
        bgzf.write_alignments(broken, str(path), CHROMS, files=3)
    assert not path.exists()
    bgzf.write_alignments(rows, str(path), CHROMS, files=2)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception):
        bgzf.write_alignments(broken, str(path), CHROMS, files=3)
    assert sorted(os.listdir(path)) == before
    bgzf.write_alignments(rows.limit(5), str(path), CHROMS, files=1, mode="append")
    assert bgzf.read_alignments(spark, str(path)).count() == 305
    bgzf.write_alignments(rows.limit(5), str(path), CHROMS, files=1)
    assert bgzf.read_alignments(spark, str(path)).count() == 5


def test_damage_is_an_error(spark, tmp_path):
    bgzf.write_alignments(reads(spark, 200), str(tmp_path / "x"), CHROMS, files=1)
    name = one_file(str(tmp_path / "x"))
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 255
    (tmp_path / "bad.bam").write_bytes(data)
    with pytest.raises(Exception):
        bgzf.read_alignments(spark, str(tmp_path / "bad.bam")).count()


def variants(spark, n=4000):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        gt = [(f"s{k}", {"GT": rnd.choice(["0/0", "0/1", "1|1", "./."]), "DP": str(rnd.randint(0, 99))}) for k in range(5)]
        rows.append((rnd.choice(CHROMS), rnd.randint(1, 300_000), f"v{i}", "ACGT"[: rnd.randint(1, 4)], ["G"], float(i % 50), ["LOW"][: i % 2], {"AN": str(i)}, gt))
    return spark.createDataFrame(rows, packed.VARIANTS_SQL)


def test_variants(spark, tmp_path):
    rows, path = variants(spark).cache(), str(tmp_path / "bcf")
    bgzf.write_variants(rows, path, CHROMS, [f"s{k}" for k in range(5)], ["LOW"], ["AN"], ["GT", "DP"], files=2)
    columns = ("chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "samples")
    for split in (1 << 30, 3_000):
        assert shown(bgzf.read_variants(spark, path, split=split), *columns) == shown(rows, *columns)
    assert shown(packed.read_packed_variants(spark, f"{path}/*.bcf"), *columns) == shown(rows, *columns)
    got = bgzf.read_variants(spark, path, "2:100000-100900;4:5")
    size = F.length("ref") - 1
    want = rows.filter(((F.col("chrom") == "2") & (F.col("pos") <= 100_900) & (F.col("pos") + size >= 100_000)) | ((F.col("chrom") == "4") & (F.col("pos") <= 5) & (F.col("pos") + size >= 5)))
    assert shown(got, "id") == shown(want, "id")


def test_lines(spark, tmp_path):
    rows, path = variants(spark, 3000).cache(), str(tmp_path / "vcf")
    cells = rows.select("chrom", "pos", "ref", "alts", F.explode("samples").alias("s")).select("chrom", "pos", "ref", "alts", "s.*").dropDuplicates(["chrom", "pos", "ref", "alts", "sample"])
    names = [f"s{k}" for k in range(5)]
    single = rows.dropDuplicates(["chrom", "pos", "ref", "alts"])
    lines = sinks.vcf_lines(single, cells, names, ("GT", "DP")).cache()
    bgzf.write_lines(lines, path, ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])], files=2)
    plain = sorted(r.value for r in lines.select("value").collect())
    for split in (1 << 30, 2_000, 400):
        got = [r.value for r in bgzf.read_lines(spark, path, split=split).collect()]
        assert sorted(x for x in got if not x.startswith("#")) == plain
    assert sorted(x.value for x in spark.read.text(f"{path}/*.vcf.gz").filter("value NOT LIKE '#%'").collect()) == plain
    some = bgzf.read_lines(spark, path, "3:1000-90000")
    back = text.read_variants(spark, some)
    want = single.filter("chrom = '3' AND pos <= 90000 AND pos + length(ref) - 1 >= 1000")
    assert shown(back, "id", "pos") == shown(want, "id", "pos")
    g = text.read_genotypes(spark, some)
    assert g.count() == 5 * want.count() and {r.sample for r in g.select("sample").distinct().collect()} == set(names)


def test_other_indices(bam):
    """The same chunks from an index with windows of places as from one with least offsets by bin."""
    import struct

    _, path = bam
    name = one_file(path)
    csi = bgzf.read_index(open(name + ".csi", "rb").read())
    reader = bgzf.RangeReader(bgzf.Alignments, bgzf.Range(name, 0, os.path.getsize(name) << 16, True))
    built = bgzf.IndexBuilder()
    for at, record, after in reader.records():
        built.add(*reader.form.span(record), at, after)
    out = [b"BAI\1", struct.pack("<i", len(CHROMS))]
    for ref in range(len(CHROMS)):
        own, windows = built.bins.get(ref, {}), built.windows.get(ref, {})
        out.append(struct.pack("<i", len(own)))
        for number, chunks in own.items():
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        out.append(struct.pack("<i", max(windows, default=-1) + 1))
        out += [struct.pack("<Q", windows.get(w, 0)) for w in range(max(windows, default=-1) + 1)]
    bai = bgzf.read_index(b"".join(out))
    found = list(reader.records())
    for ref in range(len(CHROMS)):
        for beg, end in ((0, 100), (100_000, 130_000), (399_999, 400_000)):
            need = [at for at, record, _ in found if (s := reader.form.span(record))[0] == ref and s[1] < end and s[2] > beg]
            for index in (csi, bai):
                chunks = index.chunks(ref, beg, end)
                assert all(any(a <= at < z for a, z in chunks) for at in need)
    assert bgzf.bin_of(0, 1) == 4681 and bgzf.bin_of(0, 1 << 29) == 0 and bgzf.bin_of(16383, 16385) == 585
    assert bgzf.regions_of("2:5-9,3;4:7") == [bgzf.Region("2", 5, 9), bgzf.Region("3"), bgzf.Region("4", 7, 7)]


def test_dense_genotyping_of_indexed_files(spark, tmp_path):
    """The command over two samples' BAM files and a block-compressed VCF, whole and for a region."""
    from strandline.__main__ import main

    rnd = random.Random(2)
    truth = {(s, k): rnd.choice([0, 1, 2]) for s in "ab" for k in range(6)}
    for s in "ab":
        rows = [
            (f"{s}{k}.{i}", 0, str(1 + k % 2), 1000 * k + 95, 60, "11M", "*", 0, 0, "AAAAA" + ("C" if rnd.random() < (0, 0.5, 1)[truth[s, k]] else "A") + "AAAAA", "I" * 11, {}, {})
            for k in range(6) for i in range(24)
        ]
        bgzf.write_alignments(spark.createDataFrame(rows, packed.READS_SQL).withColumn("rnext", F.lit(None).cast("string")), str(tmp_path / f"{s}.bam"), CHROMS, files=1)
    sites = spark.createDataFrame([(str(1 + k % 2), 1000 * k + 100, None, "A", ["C"], None, [], {}) for k in range(6)], "chrom string, pos int, id string, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>")
    bgzf.write_lines(sinks.vcf_lines(sites), str(tmp_path / "sites"), ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"], files=1)
    for regions, places in ((None, range(6)), ("2:900-3200", (1, 3))):
        out = str(tmp_path / f"calls-{regions is None}")
        main(["dense-genotype", "--sams", f"a={tmp_path / 'a.bam'},b={tmp_path / 'b.bam'}", "--vcf", str(tmp_path / "sites"), "--out", out, *(["--regions", regions] if regions else [])])
        got = {(r["sample"], r.snp): int(r.gt) for r in spark.read.csv(out, sep="\t", header=True).collect()}
        assert got == {(s, f"{1 + k % 2}:{1000 * k + 100}:A:C"): truth[s, k] for s in "ab" for k in places}
