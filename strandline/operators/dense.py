"""Genotypes of known variants in many samples, from their reads to calls and site statistics in one flow.

Reads meet variants by bins of the genome: a read is dealt to the bins that it spans,
a variant to its own, so what a sweep with a moving window of variants would hold is
one bin's rows of an equi-join.  A read that meets a variant leaves an allele and
a quality; sums by (sample, variant) are formed map-side, in the pass that reads them,
and no base is written down.  Cells without a read are no
rows; where frequencies need them they count as flat likelihoods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import reads as rd
from strandline.operators.genotyping import covariate_sums, pl_sums, pls_of_sums, site_statistics, sums_over_samples
from strandline.operators.lineage import cut
from strandline.operators.variants import best_guess, hwe_score, pooled_af_em

#: Flags of reads that are left out, and the least share of foreign bases that is assumed.
EXCLUDED_FLAGS = 0x704
MIN_CONTAMINATION = 0.01
#: Quality of a length difference, for each base, and of a read that does not span an indel.
INDEL_QUALITY = 30
PARTIAL_QUALITY = 20
OTHER = 2
#: Rows of variants or samples up to which they go to every task; more are dealt, with the reads.
SMALL = 100_000
#: Columns of the bases that the site statistics correlate with the allele.
COVARIATES = {"bqz": "bq", "stz": "fwd", "mqz": "mapq", "cyz": "cycle"}


def observed_alleles(reads: DataFrame, sites: DataFrame, width: int = 1000) -> DataFrame:
    """(sample, snp, allele, bq, fwd, mapq, cycle) of every read (sample, flag, chrom, pos, mapq, cigar, seq, qual) at every variant that it covers.

    ``sites`` are (snp, chrom, pos, ref, alt) with one alternate allele.  Allele 0 is the
    reference, 1 the alternate, 2 anything else.  A single base is read where the
    alignment has one.  An indel is the inserted or deleted stretch right after its
    place, of a read that spans it; other lengths there are something else.
    """
    told = reads.select("sample", "chrom", F.col("pos").alias("beg"), "mapq", "seq", "qual", (F.col("flag").bitwiseAND(16) == 0).alias("fwd"), rd.cigar_ops(F.col("cigar")).alias("ops"))
    last = F.try_element_at("ops", F.lit(-1))
    size = F.coalesce(last["r"] + F.when(last["op"].isin("M", "D", "N", "=", "X"), last["n"]).otherwise(0), F.lit(0))
    # an end is never null and conditions stand inside what is spread, since filters would work out again what they are about
    spans = told.withColumn("end", F.coalesce(F.col("beg") + size - 1, F.lit(-1)))
    bins = F.when(F.col("end") >= F.col("beg"), F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end") / width)))
    spans = spans.withColumn("_bin", F.explode(bins))
    placed = sites.select("snp", "chrom", F.col("pos").alias("site"), "ref", "alt").withColumn("_bin", F.floor(F.col("site") / width))
    met = spans.join(placed, ["chrom", "_bin"]).filter("site BETWEEN beg AND end")
    at = F.col("site") - F.col("beg")  # place on the reference from the read's first base
    own = F.get(F.filter("ops", lambda o: o["op"].isin("M", "=", "X") & (o["r"] <= at) & (at < o["r"] + o["n"])), F.lit(0))
    after = F.get(F.filter("ops", lambda o: o["op"].isin("I", "D") & (o["r"] == at + 1)), F.lit(0))
    met = met.select(
        "sample", "snp", "fwd", "mapq", "seq", "qual", "site", "ref", "alt", "end", at.alias("at"),
        own.alias("own"), F.when(F.length("alt") != F.length("ref"), after).alias("after"),
    )
    own, after = F.col("own"), F.col("after")
    place = own["q"] + F.col("at") - own["r"]
    base, quality = F.substring("seq", place + 1, F.lit(1)), F.ascii(F.substring("qual", place + 1, F.lit(1))) - 33
    longer = F.length("alt") - F.length("ref")
    size = F.abs(longer)
    told = F.when(longer > 0, F.substring("alt", F.lit(2), size)).otherwise("")
    read = F.when(after["op"] == "I", F.substring("seq", after["q"] + 1, after["n"])).otherwise("")
    same = (F.when(longer > 0, "I").otherwise("D") == after["op"]) & (after["n"] == size) & (read == told)
    wrong = F.when((longer > 0) == (after["op"] == "I"), F.abs(size - F.when(after["op"] == "D", after["n"]).otherwise(0)) * INDEL_QUALITY).otherwise(INDEL_QUALITY)
    whole = F.col("site") + F.length("ref") - 1 <= F.col("end")
    indel = F.struct(
        F.when(~whole, OTHER).when(after.isNull(), 0).when(same, 1).otherwise(OTHER).alias("allele"),
        F.when(~whole, PARTIAL_QUALITY).when(after.isNull() | same, size * INDEL_QUALITY).otherwise(wrong).cast("int").alias("bq"),
    )
    single = F.struct(
        F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1).otherwise(OTHER).alias("allele"), quality.cast("int").alias("bq")
    )
    cycle = (F.coalesce(place, F.lit(0)) + 1).cast("int")
    as_row = lambda x: F.array(F.struct(x["allele"].alias("allele"), x["bq"].alias("bq"), cycle.alias("cycle")))
    seen = met.select("sample", "snp", "fwd", "mapq", F.inline(F.when(longer != 0, as_row(indel)).when(own.isNotNull(), as_row(single))))
    return seen.select("sample", "snp", "allele", "bq", "fwd", "mapq", "cycle")


def _small(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` worked out once, sent to every task if they are few, and their number."""
    rows = cut(rows)
    n = rows.count()
    return (F.broadcast(rows) if n <= SMALL else rows), n


def dense_genotypes(
    reads: DataFrame, sites: DataFrame, samples: DataFrame, exclude: int = EXCLUDED_FLAGS, min_mapq: int = 0,
    min_contamination: float = MIN_CONTAMINATION, rounds: int = 10, width: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """(calls, site statistics) of variants in ``samples`` (sample, contamination).

    Calls: sample, snp, dp, ad0, ad1, pl0, pl1, pl2, gt, gq of every pair with a read; a
    cell without reads has the likeliest genotype of the frequency.  Sites: snp, af,
    z and f of the Hardy-Weinberg test over all samples, depth and the statistics of
    :func:`site_statistics`; variants without a read have no row.
    """
    kept = rd.read_filter(reads, exclude, min_mapq)
    share, n = _small(samples.select("sample", F.greatest(F.coalesce("contamination", F.lit(0.0)), F.lit(min_contamination)).alias("contamination")))
    seen = observed_alleles(kept, _small(sites.select("snp", "chrom", "pos", "ref", "alt"))[0], width).join(share, "sample")
    per = cut(seen.filter("allele < 2").groupBy("sample", "snp").agg(*pl_sums(F.col("contamination")), *covariate_sums(COVARIATES)))
    pls = cut(pls_of_sums(per))
    afs = cut(pooled_af_em(pls, rounds, samples=n))
    guess = best_guess(pls, afs)
    calls = pls.join(guess, ["sample", "snp"])
    sums = sums_over_samples(per, guess.filter("gt = 1"), COVARIATES)
    tests = hwe_score(pls, afs, samples=n).select("snp", "af", "z", "f")
    return calls, tests.join(site_statistics(sums).withColumnRenamed("n_samples", "n_with_reads"), "snp")
