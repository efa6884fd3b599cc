from strandline.operators import dense


def made(spark, n):
    reads = spark.createDataFrame(
        [(f"s{i % 2}", i % 3 * 16, "1", 1 + i % 2, 30, "8M3I9M" if i % 5 else None, "ACGTACGTTGCAACGTNACG", "I" * 20) for i in range(n)],
        "sample string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual string",
    )
    sites = spark.createDataFrame([("a", "1", 4, "T", "G"), ("b", "1", 8, "T", "TTGC")], "snp string, chrom string, pos int, ref string, alt string")
    samples = spark.createDataFrame([("s0", None), ("s1", 0.05)], "sample string, contamination double")
    return reads, sites, samples


def test_bases_are_summed_as_they_are_read(spark, monkeypatch):
    kept, cut = [], dense.cut
    monkeypatch.setattr(dense, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    calls, stats = dense.dense_genotypes(*made(spark, 120))
    assert max(df.count() for df in kept) <= 4
    got = {(r["sample"], r.snp): r.dp for r in calls.collect()}
    plain = {}
    for r in dense.observed_alleles(*made(spark, 120)[:2]).filter("allele < 2").collect():
        plain[r["sample"], r.snp] = plain.get((r["sample"], r.snp), 0) + 1
    assert got == plain and len(got) == 4
    assert {r.snp: r.dp for r in stats.collect()} == {s: sum(n for (_, t), n in got.items() if t == s) for s in "ab"}


def test_cigars_are_parsed_once(spark, tmp_path):
    reads, sites, _ = made(spark, 20)
    reads.write.parquet(str(tmp_path / "reads"))
    seen = dense.observed_alleles(spark.read.parquet(str(tmp_path / "reads")), sites)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert not any("aggregate(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_many_variants_are_dealt(spark, monkeypatch):
    few = sorted(map(tuple, dense.dense_genotypes(*made(spark, 60))[0].collect()))
    monkeypatch.setattr(dense, "SMALL", 1)
    assert sorted(map(tuple, dense.dense_genotypes(*made(spark, 60))[0].collect())) == few
